"""The catalog's queries as SQL, written apart from the DataFrame code."""

from __future__ import annotations

VP = """vp AS (SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, a.label AS label_a, b.label AS label_b, a.label = b.label AS same,
  round(list_dot_product(a.v, b.v), 6) AS cos, round(abs(a.v[1] - b.v[1]), 6) AS feature
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id < b.vec_id)"""
TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def jac(a: str, b: str) -> str:
    x, y = TOK.format(a), TOK.format(b)
    return f"(CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END)"


DP = f"""dp0 AS (SELECT doc_id, lang, source, text AS a, lead(text) OVER (PARTITION BY lang, source ORDER BY doc_id) AS b FROM documents),
dp AS (SELECT *, {jac('a', 'b')} AS jaccard FROM dp0 WHERE b IS NOT NULL)"""
LP = DP + ", lp AS (SELECT dp.*, l.quality, l.toxic FROM dp JOIN labels l USING (doc_id))"
SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
DS = r"""ds0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, s[i] AS sent FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM ds0))"""


def ws(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda x: x <> '')"


def ranked(source: str, score: str, positive: str, by: str = "", lower: bool = True) -> str:
    """CTE ``r`` with n_pos, n_neg, u2."""
    key, comma = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    u = "sum(p * (2 * h + q))" if lower else "2 * sum(p) * sum(q) - sum(p * (2 * h + q))"
    return f"""rc_cells AS (SELECT {key}{score}, sum(CASE WHEN {positive} THEN 1 ELSE 0 END) AS p, sum(CASE WHEN {positive} THEN 0 ELSE 1 END) AS q FROM {source} GROUP BY {key}{score}),
hi AS (SELECT *, coalesce(sum(q) OVER ({comma}ORDER BY {score} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM rc_cells),
r AS (SELECT {key}sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, ({u})::BIGINT AS u2 FROM hi {('GROUP BY ' + by) if by else ''})"""


GRID = "g AS (SELECT round(i / 100.0, 2)::DOUBLE AS threshold FROM range(0, 101) t(i))"


def balanced(where: str) -> str:
    return f"(SELECT threshold, (avg(CASE WHEN NOT same THEN (cos < threshold)::INT END) + avg(CASE WHEN same THEN (cos >= threshold)::INT END)) / 2 AS b FROM g, (SELECT same, cos FROM vp WHERE {where}) GROUP BY threshold)"


def strata(closed: bool) -> str:
    inside = "feature BETWEEN lo AND hi" if closed else "feature >= lo AND (feature < hi OR (k = 9 AND feature <= hi))"
    least = 5 if closed else 1
    return f"""WITH {VP}, e AS (SELECT k, (SELECT quantile_cont(feature, 0.1 * 0) FROM vp WHERE false) AS z FROM range(10) t(k)),
ed AS (SELECT quantile_cont(feature, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM vp),
b AS (SELECT k, q[k + 1] AS lo, q[k + 2] AS hi FROM range(10) t(k), ed), x AS (SELECT k, cos, same FROM vp JOIN b ON {inside}),
{ranked('x', 'cos', 'NOT same', 'k')}
SELECT count(*) AS strata, round(sum((n_pos + n_neg) * (u2 / (2.0 * n_pos * n_neg))) / sum(n_pos + n_neg), 6) AS auroc FROM r WHERE n_pos >= {least} AND n_neg >= {least}""".replace("e AS (SELECT k, (SELECT quantile_cont(feature, 0.1 * 0) FROM vp WHERE false) AS z FROM range(10) t(k)),\n", "")


ANCHORS = f"""an AS (SELECT item_id, text AS orig, array_to_string({ws('text')}[1:len({ws('text')}) - 1], ' ') AS para,
  coalesce(lead(text) OVER (ORDER BY item_id), first_value(text) OVER (ORDER BY item_id)) AS affirm, CASE WHEN item_id % 10 <> 0 THEN text END AS scope FROM benchmark),
el AS (SELECT *, greatest(len({ws('orig')}), len({ws('para')}), len({ws('affirm')})) AS longest FROM an),
eb AS (SELECT el.*, bin::INT AS bin, ceil(bin / 1.3) AS w, longest <= ceil(bin / 1.3) / 2 AS fits FROM el, unnest([64, 96, 128, 256, 512, 1024, 2048, 4096]) u(bin))"""
FOLD = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


def sents(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _place(k: int) -> str:
    """CTE of the k-th of four draws without replacement: one below the bound n - 4 + k, or the bound's own if that was drawn."""
    t = f"floor(('0x' || substr(md5('20260805|' || item_id || '|' || lang || '|' || (n - 4 + {k})), 1, 8))::BIGINT / 4294967296.0 * (n - 4 + {k}))::BIGINT"
    return f"p{k} AS (SELECT item_id, lang, n, CASE WHEN n - 4 + {k} < 1 THEN have ELSE list_append(have, CASE WHEN list_contains(have, {t}) THEN n - 4 + {k} - 1 ELSE {t} END) END AS have FROM p{k - 1})"


#: Hosts have the words of the longest bin that any document of their language reaches; of four drawn ones the first counts
#: that holds no payload of the anchor.
HOSTS = f"""rc AS (SELECT doc_id, lang, text, n, (SELECT max(bin) FROM unnest([64, 96, 128, 256, 512, 1024, 2048, 4096]) u(bin) WHERE ceil(bin / 1.3) <= n)::INT AS reach FROM (SELECT doc_id, lang, text, len({ws('text')}) AS n FROM documents)),
mx AS (SELECT lang, max(reach) AS most FROM rc GROUP BY lang), ho AS (SELECT rc.* FROM rc JOIN mx ON rc.lang IS NOT DISTINCT FROM mx.lang AND reach = most),
hn AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM ho),
p0 AS (SELECT item_id, lang, n, []::BIGINT[] AS have FROM an, (SELECT DISTINCT lang, n FROM hn)),
{", ".join(_place(k) for k in (1, 2, 3, 4))},
pr AS (SELECT item_id, lang, unnest(have) AS place FROM p4),
dr AS (SELECT item_id, lang, row_number() OVER (PARTITION BY item_id, lang ORDER BY md5('20260805|' || item_id || '|' || lang || '|' || place), place)::INT AS r, doc_id FROM pr JOIN hn USING (lang, place)),
hf AS (SELECT doc_id, {FOLD.format('text')} AS body FROM ho),
cl AS (SELECT item_id, dr.lang, min(r) AS r, arg_min(dr.doc_id, r) AS doc_id FROM dr JOIN an USING (item_id) JOIN hf ON hf.doc_id = dr.doc_id
  WHERE NOT contains(body, {FOLD.format('orig')}) AND NOT contains(body, {FOLD.format('para')}) AND NOT contains(body, {FOLD.format('affirm')}) AND NOT coalesce(contains(body, {FOLD.format('scope')}), false) GROUP BY item_id, dr.lang)"""
#: A frame: whole sentences while the budget lasts, then the first words of the next.
CELLS = f"""{ANCHORS}, {HOSTS},
hs AS (SELECT doc_id, i, s[i] AS sent, len({ws('s[i]')}) AS c FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {sents('text')} AS s FROM ho WHERE doc_id IN (SELECT doc_id FROM cl)))),
hp AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY i) - c AS before FROM hs),
c0 AS (SELECT eb.item_id, cl.lang, cl.doc_id, bin, w, orig, para, affirm, scope, w - len({ws('orig')}) AS room FROM eb JOIN cl ON cl.item_id = eb.item_id JOIN ho ON ho.doc_id = cl.doc_id WHERE fits AND bin <= reach),
c1 AS (SELECT item_id, c0.lang, bin, any_value(w) AS w, any_value(orig) AS orig, any_value(para) AS para, any_value(affirm) AS affirm, any_value(scope) AS scope,
  list(CASE WHEN before + c <= room THEN sent ELSE array_to_string({ws('sent')}[1:(room - before)::INT], ' ') END ORDER BY i) AS frame FROM c0 JOIN hp ON hp.doc_id = c0.doc_id AND before < room GROUP BY item_id, c0.lang, bin),
c2 AS (SELECT *, least(len(frame), floor(qq * (len(frame) + 1)))::INT AS slot FROM c1, (VALUES ('early', 0.05::DOUBLE), ('middle', 0.5::DOUBLE), ('late', 0.95::DOUBLE)) p(position, qq)),
c3 AS (SELECT item_id, lang, bin, position, slot, frame, pair, orig AS x, y, array_to_string(list_concat(list_concat(frame[1:slot], [orig]), frame[slot + 1:]), ' ') AS text_a, array_to_string(list_concat(list_concat(frame[1:slot], [y]), frame[slot + 1:]), ' ') AS text_b
  FROM (SELECT *, 'flip' AS pair, affirm AS y FROM c2 UNION ALL SELECT *, 'faithful', para FROM c2 UNION ALL SELECT *, 'scope', scope FROM c2 WHERE scope IS NOT NULL AND greatest(len({ws('orig')}), len({ws('scope')})) <= w / 2)),
ce AS (SELECT item_id, lang, bin, position, slot, pair, text_a, text_b, len({ws('x')})::INT AS payload_ws, {jac('text_a', 'text_b')} AS score FROM c3)"""
CURVE = CELLS + ", cu AS (SELECT bin, avg(1 - score) AS y FROM ce WHERE pair = 'flip' GROUP BY bin)"


def draws(units: str, unit: str, reps: int = 10_000) -> str:
    return f"""un AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS i FROM (SELECT DISTINCT {unit} FROM {units})), nn AS (SELECT count(*) AS n FROM un),
dw AS (SELECT rep, i, count(*) AS w FROM (SELECT rep, floor(('0x' || substr(md5('20260805|' || rep || '|' || un.i), 1, 8))::BIGINT / 4294967296.0 * n)::BIGINT AS i FROM un, nn, range(1, {reps + 1}) t(rep)) GROUP BY rep, i),
dd AS (SELECT rep, {unit}, w FROM dw JOIN un USING (i))"""


KW = r"list_sort(regexp_extract_all({0}, '\b(that|from|this|with|the)\b', 1))"
NUM = r"list_sort(regexp_extract_all({0}, '\d+(?:\.\d+)?'))"
EDIT = f"(CASE WHEN {KW.format('a')} <> {KW.format('b')} THEN 'keyword' WHEN {NUM.format('a')} <> {NUM.format('b')} THEN 'number' ELSE 'other' END)"


def alpha(x: str) -> str:
    return rf"(CASE WHEN length(regexp_replace({x}, '\s', '', 'g')) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))::DOUBLE / length(regexp_replace({x}, '\s', '', 'g')) END)"


def code(x: str) -> str:
    lines = rf"list_filter(string_split_regex({x}, '\r\n|[\n\r\x0B\x0C]'), lambda x: NOT regexp_matches(x, '^\s*$'))"
    line = r"""(::=|=/|^[\s|+\-=_*#0-9a-fA-Fx,.:;()\[\]{}<>/\\''"]+$)"""
    return f"(CASE WHEN len({lines}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({lines}, lambda x: regexp_matches(x, '{line}')))::DOUBLE / len({lines}) END)"


def markup(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "''''"), ("amp", "'&'")):
        x = f"replace({x}, '&{name};', {char})"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


STOP = "['the','a','an','of','to','in','for','is','are','be','and','or','as','by','on','with','that','this','it','its']"  # a fixed value
Z = "1.959964"

SQL = {
    "auroc_vec_pairs": f"WITH {VP}, {ranked('vp', 'cos', 'same', lower=False)} SELECT n_pos, n_neg, u2, round(u2 / (2.0 * n_pos * n_neg), 9) AS auroc FROM r",
    "gate_operating_points": f"WITH {VP} SELECT threshold, round(tpr, 9) AS tpr, round(tnr, 9) AS tnr, round((tpr + tnr) / 2, 9) AS balanced FROM (SELECT t::DOUBLE AS threshold, avg(CASE WHEN NOT same THEN (cos < t)::INT END) AS tpr, avg(CASE WHEN same THEN (cos >= t)::INT END) AS tnr FROM vp, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) u(t) GROUP BY t)",
    "auroc_by_label": f"WITH {VP}, {ranked('vp', 'cos', 'same', 'label_a', lower=False)} SELECT label_a, n_pos, n_neg, u2, round(u2 / (2.0 * nullif(n_pos * n_neg, 0)), 9) AS auroc FROM r",
    "auroc_allpairs_check": f"WITH {VP}, {ranked('vp', 'cos', 'same', lower=False)}, c AS (SELECT cos, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS q FROM vp GROUP BY cos), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY cos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), u AS (SELECT sum(p * (2 * below + q))::BIGINT AS u FROM b) SELECT n_pos, n_neg, u2, u AS u2_by_pairs, u2 = u AS agree FROM r, u",
    "cliffs_delta_jaccard": f"WITH {LP}, {ranked('lp', 'jaccard', 'quality = 1')} SELECT n_pos, n_neg, u2, round(2 * (u2 / (2.0 * n_pos * n_neg)) - 1, 9) AS delta FROM r",
    "weighted_auroc": f"WITH {VP}, n AS (SELECT label_a, count(*) AS w FROM vp GROUP BY label_a), c AS (SELECT cos, sum(CASE WHEN same THEN w ELSE 0 END) AS p, sum(CASE WHEN same THEN 0 ELSE w END) AS q FROM vp JOIN n USING (label_a) GROUP BY cos), l AS (SELECT *, coalesce(sum(q) OVER (ORDER BY cos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM c) SELECT round(sum(p::DOUBLE * (2 * low + q)::DOUBLE) / (2 * sum(p)::DOUBLE * sum(q)::DOUBLE), 6) AS auroc FROM l",
    "pairwise_accuracy": f"WITH {VP}, m AS (SELECT vec_id_a, max(CASE WHEN same THEN cos END) AS s, max(CASE WHEN NOT same THEN cos END) AS o FROM vp GROUP BY vec_id_a) SELECT count(*) AS n, round(avg(CASE WHEN s > o THEN 1.0 WHEN s = o THEN 0.5 ELSE 0.0 END), 9) AS accuracy FROM m WHERE s IS NOT NULL AND o IS NOT NULL",
    "best_threshold": f"WITH {VP}, {GRID} SELECT threshold, round(b, 9) AS balanced FROM {balanced('true')} ORDER BY round(b, 9) DESC, threshold LIMIT 1",
    "threshold_transfer": f"WITH {VP}, {GRID}, f AS (SELECT threshold, round(b, 9) AS fitted FROM {balanced('vec_id_a % 2 = 0')} ORDER BY 2 DESC, 1 LIMIT 1), t AS (SELECT threshold, round(b, 9) AS transferred FROM {balanced('vec_id_a % 2 = 1')}) SELECT threshold, fitted, transferred, round(fitted - transferred, 9) AS drop FROM f JOIN t USING (threshold)",
    "stratified_auroc_open": strata(False),
    "stratified_auroc_closed": strata(True),
    "cell_delta_two_level": f"WITH {VP}, v AS (SELECT label_a, vec_id_a, avg(CASE WHEN same THEN cos END) - avg(CASE WHEN NOT same THEN cos END) AS d FROM vp GROUP BY label_a, vec_id_a) SELECT label_a, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.9), 6) AS p90 FROM v WHERE d IS NOT NULL GROUP BY label_a",
    "token_jaccard_pairs": f"WITH {DP} SELECT doc_id, lang, source, round(jaccard, 9) AS jaccard FROM dp",
    "jaccard_class_summary": f"WITH {LP} SELECT quality, count(*) AS n, round(avg(jaccard), 6) AS mean, round(median(jaccard), 6) AS median FROM lp GROUP BY quality",
    "edit_class_counts": f"WITH {DP} SELECT {EDIT} AS edit_class, count(*) AS n FROM dp GROUP BY 1",
    "number_multiset_changes": f"WITH {DP} SELECT lang, sum(({NUM.format('a')} <> {NUM.format('b')})::INT)::BIGINT AS changed, sum(len({NUM.format('a')}))::BIGINT AS numbers FROM dp GROUP BY lang",
    "code_primary_flags": f"WITH {DP} SELECT doc_id, round({alpha('a')}, 6) AS alpha, round({code('a')}, 6) AS code, {alpha('a')} < 0.70 OR {code('a')} >= 0.5 OR {alpha('b')} < 0.70 OR {code('b')} >= 0.5 AS code_primary FROM dp",
    "sentence_counts": f"WITH {DS} SELECT doc_id, count(*) AS n, sum((length(sent) BETWEEN 30 AND 600)::INT)::BIGINT AS n_fit, max(length(sent)) AS longest FROM ds GROUP BY doc_id",
    "markup_strip_pages": f"SELECT page_id, sha256({markup('html')}) AS digest FROM pages",
    "sentence_alignment": f"WITH {DS}, st AS (SELECT doc_id, pos, list_filter({TOK.format('sent')}, lambda x: NOT list_contains({STOP}, x)) AS t FROM ds WHERE length(sent) BETWEEN 30 AND 600), w AS (SELECT doc_id, pos, unnest(t) AS w FROM st), nr AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, count(*) AS n FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.w = b.w GROUP BY ALL HAVING count(*) >= 2), sc AS (SELECT nr.doc_id, i, j, round(n::DOUBLE / (len(x.t) + len(y.t) - n), 9) AS jac FROM nr JOIN st x ON x.doc_id = nr.doc_id AND x.pos = i JOIN st y ON y.doc_id = nr.doc_id + 1 AND y.pos = j) SELECT doc_id, i::INT AS pos, j::INT AS match, jac AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY jac DESC, j) AS r FROM sc) WHERE r = 1",
    "contamination_scan": rf"""WITH it AS (SELECT item_id, {FOLD.format('text')} AS item FROM benchmark), ip AS (SELECT *, {sents('item')} AS ss FROM it), pr AS (SELECT item_id, item, unnest([1, 2, 3]) AS k, unnest([left(item, 250), coalesce(ss[len(ss) // 2 + 1], item), right(item, 250)]) AS probe FROM ip),
tk AS (SELECT *, {ws('probe')} AS t FROM pr), ti AS (SELECT *, CASE WHEN len(t) > 2 THEN t[2:len(t) - 1] ELSE t END AS inn FROM tk), ak AS (SELECT *, inn[list_position(list_transform(inn, lambda x: length(x)), list_max(list_transform(inn, lambda x: length(x))))] AS anchor FROM ti),
dc AS (SELECT doc_id, {FOLD.format('text')} AS body FROM documents), dw AS (SELECT doc_id, unnest(list_distinct({ws('body')})) AS anchor FROM dc), nr AS (SELECT DISTINCT item_id, doc_id FROM dw JOIN ak USING (anchor)),
hi AS (SELECT nr.item_id, nr.doc_id, list(k ORDER BY k) FILTER (WHERE contains(body, probe)) AS hit, bool_or(contains(body, item)) AS whole FROM nr JOIN pr ON pr.item_id = nr.item_id JOIN dc ON dc.doc_id = nr.doc_id GROUP BY nr.item_id, nr.doc_id),
be AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY len(hit) DESC, doc_id) AS r FROM hi WHERE hit IS NOT NULL), ag AS (SELECT item_id, sum(whole::INT)::BIGINT AS n, min(CASE WHEN whole THEN doc_id END) AS first_doc FROM be GROUP BY item_id)
SELECT it.item_id, CASE WHEN len(hit) = 3 THEN 'full' WHEN hit IS NOT NULL THEN 'partial' ELSE 'none' END AS tier, coalesce(array_to_string(list_transform(hit, lambda x: ['first', 'middle', 'last'][x]), ','), '') AS probes, be.doc_id AS best_doc, coalesce(n, 0) AS n, first_doc FROM it LEFT JOIN be ON be.item_id = it.item_id AND r = 1 LEFT JOIN ag ON ag.item_id = it.item_id""",
    "first_occurrence_dedupe": "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text",
    "split_overlap": "SELECT count(*) AS n_shared FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)",
    "duplicate_merge": "SELECT user_id, event_type, round(avg(value), 6) AS value, max(ts)::VARCHAR AS last_ts, bool_or(value > 100) AS large, count(*) - 1 AS n_merged FROM events GROUP BY user_id, event_type",
    "stratified_sample": "SELECT doc_id, lang, r::INT AS r FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('20260805|' || lang || '|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20",
    "blind_packet": f"WITH {DP}, h AS (SELECT *, md5('20260805|' || doc_id) AS h FROM dp) SELECT doc_id, row_number() OVER (ORDER BY h, doc_id)::INT AS item, md5(CASE WHEN substr(h, 32, 1) IN ('1','3','5','7','9','b','d','f') THEN b ELSE a END) AS first, substr(h, 32, 1) IN ('1','3','5','7','9','b','d','f') AS flipped FROM h",
    "host_draw": f"WITH {ANCHORS}, {HOSTS} SELECT item_id, lang, r, doc_id FROM dr",
    "shard_parity": "SELECT CASE WHEN right(sha256(doc_id::VARCHAR), 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE 0 END AS shard, lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "shard_merge_violations": "SELECT vec_id, 2::BIGINT AS n, 1::BIGINT AS labels FROM embeddings WHERE vec_id % 50 = 0",
    "attrition_table": f"WITH {ANCHORS} SELECT bin, sum(fits::INT)::BIGINT AS eligible, sum((NOT fits)::INT)::BIGINT AS dropped, sum((fits AND scope IS NOT NULL)::INT)::BIGINT AS scope_eligible, round(sum((NOT fits)::INT)::DOUBLE / count(*), 9) AS dropped_share FROM eb GROUP BY bin",
    "constant_cohort": f"WITH {ANCHORS} SELECT item_id FROM eb GROUP BY item_id HAVING bool_and(fits)",
    "splice_stimuli": f"WITH {CELLS}, un AS (SELECT eb.item_id, mx.lang, eb.bin, position FROM eb CROSS JOIN mx LEFT JOIN cl ON cl.item_id = eb.item_id AND cl.lang = mx.lang, unnest(['early', 'middle', 'late']) v(position) WHERE fits AND (cl.doc_id IS NULL OR most IS NULL OR eb.bin > most)) SELECT item_id, lang, bin, position, pair, sha256(text_a) AS a, sha256(text_b) AS b, payload_ws, round(score, 9) AS score FROM ce UNION ALL SELECT item_id, lang, bin, position, NULL, NULL, NULL, NULL, NULL FROM un",
    "position_slot_collisions": f"WITH {CELLS} SELECT bin, count(*) AS n_collisions FROM (SELECT bin FROM ce WHERE pair = 'flip' GROUP BY item_id, lang, bin, slot HAVING count(*) > 1) GROUP BY bin",
    "grouping_pooled_position": f"WITH {CELLS} SELECT bin, pair, position, count(*) AS n, round(avg(score), 6) AS mean FROM ce GROUP BY GROUPING SETS ((bin, pair), (bin, pair, position))",
    "isotonic_curve": f"WITH {CURVE}, m AS (SELECT i.bin AS i, j.bin AS j, (SELECT avg(y) FROM cu k WHERE k.bin BETWEEN i.bin AND j.bin) AS m FROM cu i JOIN cu j ON i.bin <= j.bin), t AS (SELECT k.bin, m.i, max(m) AS top FROM m JOIN cu k ON m.i <= k.bin AND m.j >= k.bin GROUP BY k.bin, m.i) SELECT cu.bin, round(y, 6) AS y, round(min(top), 6) AS fitted FROM cu JOIN t ON t.bin = cu.bin GROUP BY cu.bin, y",
    "power_law_fit": f"WITH {CURVE}, p AS (SELECT ln(y) AS ly, ln(64.0 / bin) AS lx FROM cu WHERE y > 0) SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(regr_slope(ly, lx), 5) END AS exponent, CASE WHEN count(*) >= 3 THEN round(exp(regr_intercept(ly, lx)), 5) END AS scale FROM p",
    "critical_length": f"WITH {CURVE}, nx AS (SELECT *, lead(y) OVER (ORDER BY bin) AS nxt FROM cu) SELECT min(CASE WHEN y < 0.1 AND coalesce(nxt, y) < 0.1 THEN bin END) AS first_bin, round(min(y), 6) AS least, round(max(y), 6) AS most FROM nx",
    "cohen_kappa": "WITH r AS (SELECT quality AS a, 1 - toxic AS b FROM labels), o AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM r), e AS (SELECT sum((SELECT count(*) FROM r WHERE a = c) * (SELECT count(*) FROM r WHERE b = c))::DOUBLE AS pe FROM (VALUES (0), (1)) v(c)) SELECT n, round(po, 9) AS agreement, round((po - pe / (n * n)) / (1 - pe / (n * n)), 9) AS kappa FROM o, e",
    "wilson_rates": f"WITH k AS (SELECT quality, count(*) AS n, sum(toxic)::BIGINT AS k FROM labels GROUP BY quality), w AS (SELECT *, k / n::DOUBLE + {Z} * {Z} / (2 * n) AS mid, {Z} * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + {Z} * {Z} / (4.0 * n * n)) AS half, 1 + {Z} * {Z} / n AS d FROM k) SELECT quality, n, k, round((mid - half) / d, 9) AS low, round((mid + half) / d, 9) AS high FROM w",
    "adjudicated_labels": "SELECT doc_id, CASE WHEN quality = 1 - toxic THEN quality WHEN n_chars > 1000 THEN 1 ELSE 0 END AS final, quality <> 1 - toxic AS adjudicated FROM labels JOIN documents USING (doc_id)",
    "noise_ceiling": "SELECT round(x, 9) AS noise_pos, round(y, 9) AS noise_neg, round(0.5 + 0.5 * (1 - x - y), 9) AS ceiling FROM (SELECT avg(CASE WHEN quality = 1 THEN toxic END) AS x, avg(CASE WHEN quality = 0 THEN 1 - toxic END) AS y FROM labels)",
    "confusion_matrix": "SELECT quality, sum((toxic = 0)::INT)::BIGINT AS toxic_0, sum((toxic = 1)::INT)::BIGINT AS toxic_1 FROM labels GROUP BY quality",
    "label_cascade_routing": f"WITH {LP}, x AS (SELECT quality, {EDIT} AS edit_class FROM lp) SELECT edit_class, CASE WHEN edit_class = CASE WHEN quality = 1 THEN 'keyword' ELSE 'other' END THEN 'agree' WHEN edit_class = 'number' THEN 'sampled' ELSE 'arbitrate' END AS route, count(*) AS n FROM x GROUP BY 1, 2",
    "cluster_bootstrap_ci": f"""WITH {VP}, un AS (SELECT label_a, row_number() OVER (ORDER BY label_a) - 1 AS i FROM (SELECT DISTINCT label_a FROM vp)), nn AS (SELECT count(*) AS n FROM un),
c AS (SELECT i, cos, sum((NOT same)::INT) AS p, sum(same::INT) AS q FROM vp JOIN un USING (label_a) GROUP BY i, cos), g AS (SELECT cos, un.i AS j, coalesce(c.q, 0) AS q FROM (SELECT DISTINCT cos FROM c) CROSS JOIN un LEFT JOIN c USING (cos, i)),
h AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY j ORDER BY cos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM g), w AS (SELECT c.i, h.j, sum(c.p * (2 * above + h.q)) AS w FROM c JOIN h USING (cos) GROUP BY c.i, h.j),
t AS (SELECT i, sum(p) AS p, sum(q) AS q FROM c GROUP BY i), dw AS (SELECT rep, i, count(*) AS k FROM (SELECT rep, floor(('0x' || substr(md5('20260805|' || rep || '|' || un.i), 1, 8))::BIGINT / 4294967296.0 * n)::BIGINT AS i FROM un, nn, range(1, 10001) t(rep)) GROUP BY rep, i),
s AS (SELECT rep, sum(k * p) AS p, sum(k * q) AS q FROM dw JOIN t USING (i) GROUP BY rep), u AS (SELECT x.rep, sum(x.k * y.k * w) AS u FROM dw x JOIN dw y ON x.rep = y.rep JOIN w ON w.i = x.i AND w.j = y.i GROUP BY x.rep),
a AS (SELECT u::DOUBLE / nullif(2.0 * p::DOUBLE * q::DOUBLE, 0) AS a FROM u JOIN s USING (rep)), {ranked('vp', 'cos', 'NOT same')} SELECT round(any_value(u2 / (2.0 * n_pos * n_neg)), 9) AS point, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM a, r""",
    "anchor_bootstrap_mean": f"WITH {LP}, x AS (SELECT doc_id, round(jaccard, 9) AS x FROM lp), {draws('x', 'doc_id')}, m AS (SELECT rep, sum(w * x) / sum(w) AS m FROM x JOIN dd USING (doc_id) GROUP BY rep) SELECT round((SELECT avg(x) FROM x), 6) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m",
    "permutation_test": f"WITH {LP}, v AS (SELECT doc_id, quality = 1 AS pos, round(round(jaccard, 6) * 1000000)::BIGINT AS x FROM lp), n AS (SELECT count(*) AS n, sum(pos::INT) AS k, sum(x) AS t, coalesce(sum(CASE WHEN pos THEN x END), 0) AS s FROM v), r AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY md5('20260805|' || rep || '|' || doc_id), doc_id) AS i FROM v, range(1, 20001) u(rep)), q AS (SELECT rep, sum(x) AS y FROM r, n WHERE i <= k GROUP BY rep) SELECT k::BIGINT AS n_pos, sum((abs(y * n - t * k) >= abs(s * n - t * k))::INT)::BIGINT AS hits, round((sum((abs(y * n - t * k) >= abs(s * n - t * k))::INT) + 1) / 20001.0, 9) AS p_value FROM q, n GROUP BY k",
    "config_parity_gate": "WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), g AS (SELECT label, abs(list_dot_product(v, v) - list_dot_product(list_transform(v, lambda x: round(x, 4)), v)) AS g FROM e) SELECT label, round(max(g), 9) AS worst, max(g) <= 1e-5 AS passes FROM g GROUP BY label",
    "cone_floor": "WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v0 FROM embeddings), u AS (SELECT label, vec_id, list_transform(v0, lambda x: x / (CASE WHEN list_dot_product(v0, v0) = 0 THEN 1 ELSE sqrt(list_dot_product(v0, v0)) END)) AS v FROM e), p AS (SELECT label, i, v[i] AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM u)), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i), mm AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY label), a AS (SELECT u.label, acos(greatest(-1, least(1, list_dot_product(v, m) / sqrt(list_dot_product(m, m))))) AS t FROM u JOIN mm USING (label)) SELECT label, count(*) AS n, round(degrees(max(t)), 4) AS max_degrees, round(cos(2 * max(t)), 5) AS floor FROM a GROUP BY label",
    "mrl_truncation": "WITH e AS (SELECT vec_id, label, embedding[1:16]::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), p AS (SELECT a.label = b.label AS same, round(list_dot_product(a.v, b.v), 4) AS cos FROM u a JOIN u b ON a.vec_id < b.vec_id), " + ranked("p", "cos", "same", lower=False) + " SELECT n_pos, n_neg, round(u2 / (2.0 * n_pos * n_neg), 5) AS auroc, round((SELECT avg(cos) FROM p WHERE same), 4) AS mean_same, round((SELECT avg(cos) FROM p WHERE NOT same), 4) AS mean_other FROM r",
    "hyperbolic_distances": f"WITH {VP} SELECT label_a, count(*) AS n, round(avg(acosh(1 + 2 * (0.5 * (1 - cos)) / 0.5625)), 6) AS mean, true AS monotone FROM vp GROUP BY label_a",
    "ext_asof_events": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events WHERE user_id IS NOT NULL",
    "ext_sessions": "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY user_id, session",
    "ext_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice) / 1000, 2) AS total_k FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
}

MATCH = f"""vq AS (SELECT vec_id_a AS c, vec_id_b, same, cos, feature AS f, row_number() OVER (PARTITION BY vec_id_a, same ORDER BY feature, vec_id_b) AS k FROM vp),
wk AS (SELECT c, 1::BIGINT AS i, 1::BIGINT AS j FROM vq GROUP BY c UNION ALL
 SELECT w.c, i + (a.f - b.f <= 0.05)::INT, j + (a.f - b.f >= -0.05)::INT FROM wk w JOIN vq a ON a.c = w.c AND NOT a.same AND a.k = w.i JOIN vq b ON b.c = w.c AND b.same AND b.k = w.j),
mt AS (SELECT a.cos AS x, b.cos AS y FROM wk w JOIN vq a ON a.c = w.c AND NOT a.same AND a.k = w.i JOIN vq b ON b.c = w.c AND b.same AND b.k = w.j WHERE abs(a.f - b.f) <= 0.05),
mr AS (SELECT x AS cos, true AS pos FROM mt UNION ALL SELECT y, false FROM mt)"""
MATCHED = f"WITH RECURSIVE {VP}, {MATCH}, {ranked('mr', 'cos', 'pos')}"
SQL["caliper_match_auroc"] = f"{MATCHED} SELECT coalesce(n_pos, 0) AS matched, CASE WHEN n_pos >= 30 THEN round(u2 / (2.0 * n_pos * n_neg), 9) END AS auroc FROM r"
SQL["artifact_share"] = f"""{MATCHED}, nv AS (SELECT sum(p * (2 * h + q))::DOUBLE / (2.0 * sum(p) * sum(q)) AS a FROM (SELECT *, coalesce(sum(q) OVER (ORDER BY cos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM (SELECT cos, sum((NOT same)::INT) AS p, sum(same::INT) AS q FROM vp GROUP BY cos))),
cp AS (SELECT CASE WHEN n_pos >= 30 THEN u2 / (2.0 * n_pos * n_neg) END AS b FROM r) SELECT round(a, 9) AS naive, round(b, 9) AS caliper, round(a - b, 9) AS share FROM nv, cp"""
SQL["native_window"] = f"""WITH f AS (SELECT item_id, doc_id, {SQUEEZE.format('d.text')} AS body, {SQUEEZE.format('b.text')} AS item FROM benchmark b JOIN documents d ON contains({FOLD.format('d.text')}, {FOLD.format('b.text')})),
p AS (SELECT *, list_last(list_filter(string_split(regexp_replace(item, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS payload FROM f),
s AS (SELECT *, strpos(lower(body), lower(item)) + strpos(lower(item), lower(payload)) - 1 AS start FROM p),
w AS (SELECT *, {ws('left(body, start - 1)')} AS before, {ws('substr(body, start + length(payload))')} AS after, len({ws('payload')}) AS k FROM s),
g AS (SELECT w.*, bin, position, q, (ceil(bin / 1.3) - k)::INT AS room FROM w, unnest([64, 96, 128, 256, 512, 1024, 2048, 4096]) u(bin), (VALUES ('early', 0.05::DOUBLE), ('middle', 0.5::DOUBLE), ('late', 0.95::DOUBLE)) v(position, q) WHERE ceil(bin / 1.3) >= k),
h AS (SELECT *, least(round_even(q * room, 0)::INT, len(before)) AS nb0 FROM g), i AS (SELECT *, least(room - nb0, len(after)) AS na FROM h), j AS (SELECT *, least(room - na, len(before)) AS nb FROM i)
SELECT item_id, doc_id, bin, position, CASE WHEN nb + na = room THEN nb END AS n_before, CASE WHEN nb + na = room THEN na END AS n_after,
 CASE WHEN nb + na = room THEN sha256(array_to_string(list_concat(list_concat(before[len(before) - nb + 1:], [payload]), after[1:na]), ' ')) END AS digest FROM j""".replace("\\\\", "\\")
SQL["first_clean_host"] = f"WITH {ANCHORS}, {HOSTS} SELECT item_id, lang, r, doc_id FROM cl"
FITTED = "m AS (SELECT i.bin AS i, j.bin AS j, (SELECT avg(y) FROM cu k WHERE k.bin BETWEEN i.bin AND j.bin) AS m FROM cu i JOIN cu j ON i.bin <= j.bin), t AS (SELECT k.bin, m.i, max(m) AS top FROM m JOIN cu k ON m.i <= k.bin AND m.j >= k.bin GROUP BY k.bin, m.i), kn AS (SELECT log2(bin) AS x, min(top) AS y FROM t GROUP BY bin)"
HERMITE = "(2*tt^3 - 3*tt^2 + 1) * yl + (xr - xl) * (tt^3 - 2*tt^2 + tt) * ml + (3*tt^2 - 2*tt^3) * yr + (xr - xl) * (tt^3 - tt^2) * mr".replace("tt", "(((lo + hi) / 2 - xl) / (xr - xl))")
SQL["level_crossing"] = f"""WITH RECURSIVE {CURVE}, {FITTED}, d AS (SELECT *, (lead(y) OVER (ORDER BY x) - y) / (lead(x) OVER (ORDER BY x) - x) AS r FROM kn), e AS (SELECT *, lag(r) OVER (ORDER BY x) AS l FROM d),
s AS (SELECT x, y, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN l * r > 0 THEN 2 * l * r / (l + r) ELSE 0 END AS m FROM e),
iv AS (SELECT lag(x) OVER (ORDER BY x) AS xl, lag(y) OVER (ORDER BY x) AS yl, lag(m) OVER (ORDER BY x) AS ml, x AS xr, y AS yr, m AS mr FROM s), lv AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) AS level),
fr AS (SELECT level, (SELECT arg_min(y, x) FROM kn) AS f, (SELECT min(xr) FROM iv WHERE xl IS NOT NULL AND yr <= level) AS knee FROM lv),
bs AS (SELECT level, 0 AS n, xl, yl, ml, xr, yr, mr, xl AS lo, xr AS hi FROM fr JOIN iv ON xr = knee WHERE f > level UNION ALL
 SELECT level, n + 1, xl, yl, ml, xr, yr, mr, CASE WHEN {HERMITE} > level THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {HERMITE} > level THEN hi ELSE (lo + hi) / 2 END FROM bs WHERE n < 60)
SELECT fr.level, CASE WHEN f <= fr.level THEN 1 WHEN knee IS NULL THEN 2 ELSE 0 END AS code, round(2.0 ^ hi, 4) AS crossing FROM fr LEFT JOIN bs ON bs.level = fr.level AND n = 60"""
_X, _Y = TOK.format("x"), TOK.format("y")
SQL["overlap_decay"] = f"""WITH {CELLS}, o AS (SELECT bin, (pair = 'flip')::INT::DOUBLE AS flip, {jac('text_a', 'text_b')} AS score, len({TOK.format("array_to_string(frame, ' ')")}) AS s, len(list_intersect({_X}, {_Y})) AS i, len({_X}) + len({_Y}) - len(list_intersect({_X}, {_Y})) AS u FROM c3 WHERE pair IN ('flip', 'faithful')),
m AS (SELECT bin, median(s) AS sb FROM o GROUP BY bin), p AS (SELECT o.*, sb, (sb + i) / (sb + u) AS pred FROM o JOIN m USING (bin))
SELECT bin, count(*) AS n, any_value(sb)::DOUBLE AS s_host, CASE WHEN count(*) >= 3 AND stddev(score) > 0 AND stddev(flip) > 0 THEN round(corr(score, flip), 5) END AS observed, CASE WHEN count(*) >= 3 AND stddev(pred) > 0 AND stddev(flip) > 0 THEN round(corr(pred, flip), 5) END AS predicted FROM p GROUP BY bin"""


def side(q: int) -> str:
    """CTEs of one class: rows, draws, medians per replicate."""
    d = draws(f"x{q}", "doc_id")
    for name in ("un", "nn", "dw", "dd"):
        d = d.replace(f"{name} AS", f"{name}{q} AS").replace(f"FROM {name}", f"FROM {name}{q}").replace(f"JOIN {name} ", f"JOIN {name}{q} ").replace(f"FROM un{q}, nn,", f"FROM un{q}, nn{q},").replace(f"{name}.i", f"{name}{q}.i")
    return f"x{q} AS (SELECT doc_id, round(jaccard, 9) AS x FROM lp WHERE quality = {q}), {d}, m{q} AS (SELECT rep, median(x) AS m FROM (SELECT rep, x, unnest(range(w)) AS _ FROM x{q} JOIN dd{q} USING (doc_id)) GROUP BY rep)"


SQL["median_gap_bootstrap"] = f"WITH {LP}, {side(1)}, {side(0)}, g AS (SELECT m1.m - m0.m AS g, row_number() OVER (ORDER BY m1.m - m0.m) AS k FROM m1 JOIN m0 USING (rep)) SELECT round((SELECT median(x) FROM x1) - (SELECT median(x) FROM x0), 6) AS point, round(min(CASE WHEN k = 250 THEN g END), 6) AS low, round(min(CASE WHEN k = 9750 THEN g END), 6) AS high FROM g"


def bar(name: str, query: str, statistic: str, inside: str, where: str = "true") -> str:
    return f"SELECT '{name}' AS bar, round({statistic}, 6)::DOUBLE AS statistic, CASE WHEN {statistic} IS NULL THEN 'vacuous' WHEN round({statistic}, 6) {inside} THEN 'pass' ELSE 'fail' END AS verdict FROM ({SQL[query]}) WHERE {where}"


SQL["scorecard"] = " UNION ALL ".join([
    bar("separation", "artifact_share", "naive", ">= 0.75"),
    bar("separation_matched", "artifact_share", "caliper", ">= 0.75"),
    bar("artifact", "artifact_share", "share", "BETWEEN -0.05 AND 0.05"),
    bar("separation_stratified", "stratified_auroc_closed", "auroc", ">= 0.75"),
    bar("agreement", "cohen_kappa", "kappa", ">= 0.6"),
    bar("length", "level_crossing", "crossing", ">= 128", "level = 0.1"),
    bar("chance", "permutation_test", "p_value", "<= 0.05"),
])
SQL["ext_stream_windows"] = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"
SQL["ext_stream_sessions"] = "WITH g AS (SELECT user_id, ts::TIMESTAMP AS ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k"
