"""siftgate: Spark-native operators for auditing similarity gates over pairs of texts and vectors."""
