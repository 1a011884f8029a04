"""Queries over corpus and alignment metrics (E) and the translation summary (G31, H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.extract import all_found
from scoreloom.operators import corpus as cp
from scoreloom.plans import sqltext as q
from scoreloom.plans.catalog import query
from scoreloom.sources.pages import inner_text

IDS = ["conv_id", "turn"]
_NOSPACE = "regexp_replace({}, '\\s+', '', 'g')"


def char_counts(src: str, ids: str, hyp: str, ref: str, order: int = 6) -> str:
    """CTE body: (ids, n, gram, h, r) over characters."""
    side = lambda c, h, r: f"SELECT {ids}, {h} AS h, {r} AS r, {_NOSPACE.format(c)} AS s FROM {src}"
    return f"""SELECT {ids}, n, substr(s, p, n) AS gram, sum(h) AS h, sum(r) AS r FROM (
      SELECT {ids}, h, r, s, n, unnest(range(1, length(s) - n + 2)) AS p FROM ({side(hyp, 1, 0)} UNION ALL {side(ref, 0, 1)}), range(1, {order + 1}) o(n)) GROUP BY ALL"""


def word_counts(src: str, ids: str, hyp: str, ref: str, order: int) -> str:
    side = lambda c, h, r: f"SELECT {ids}, {h} AS h, {r} AS r, {c} AS w FROM {src}"
    return f"""SELECT {ids}, n, array_to_string(w[p:p + n - 1], ' ') AS gram, sum(h) AS h, sum(r) AS r FROM (
      SELECT {ids}, h, r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM ({side(hyp, 1, 0)} UNION ALL {side(ref, 0, 1)}), range(1, {order + 1}) o(n)) GROUP BY ALL"""


def f_beta(keys: str, src: str) -> str:
    return f"""SELECT {keys}, round(CASE WHEN p + r > 0 THEN 100e0 * 5 * p * r / (4 * p + r) ELSE 0e0 END, 6) AS chrf FROM (
      SELECT {keys}, coalesce(avg(m / CAST(h AS DOUBLE)) FILTER (WHERE h > 0 AND r > 0), 0e0) AS p, coalesce(avg(m / CAST(r AS DOUBLE)) FILTER (WHERE h > 0 AND r > 0), 0e0) AS r FROM {src} GROUP BY {keys})"""


@query("e1_chrf_sentence", f"""
    WITH g AS ({char_counts('@pairs', 'conv_id, turn', 'hyp', 'ref')}),
    s AS (SELECT conv_id, turn, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM g GROUP BY ALL) {f_beta('conv_id, turn', 's')}""")
def _(t):
    return cp.chrf_sentence(t.pairs, IDS, "hyp", "ref")


# a translated sample: question and answer of one exchange against those of the next one
_MT = """mt AS (SELECT a.conv_id, a.turn, a.ref AS rq, a.hyp AS ra, b.ref AS hq, b.hyp AS ha FROM @pairs a JOIN pairs b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2),
    v AS (SELECT conv_id, turn, 'question' AS view, hq AS hyp, rq AS ref FROM mt UNION ALL SELECT conv_id, turn, 'answer', ha, ra FROM mt UNION ALL SELECT conv_id, turn, 'combined', hq || ' ' || ha, rq || ' ' || ra FROM mt)"""


def _mt(t):
    a = t.pairs.select("conv_id", "turn", F.col("ref").alias("rq"), F.col("hyp").alias("ra"))
    b = t.pairs.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("ref").alias("hq"), F.col("hyp").alias("ha"))
    return a.join(b, IDS)


def _views():
    both = lambda a, b: F.concat_ws(" ", a, b)
    return {"question": (F.col("hq"), F.col("rq")), "answer": (F.col("ha"), F.col("ra")), "combined": (both("hq", "ha"), both("rq", "ra"))}


_CORPUS = f"""g AS ({char_counts('v', 'conv_id, turn, view', 'hyp', 'ref')}),
    s AS (SELECT view, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM g GROUP BY ALL)"""


@query("e2_chrf_corpus", f"WITH {_MT}, {_CORPUS} {f_beta('view', 's')}")
def _(t):
    return cp.chrf_corpus(_mt(t), IDS, _views())


@query("g31_mt_summary", f"""WITH {_MT}, {_CORPUS}, per AS (SELECT conv_id, turn, view, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM g GROUP BY ALL),
    sent AS ({f_beta('conv_id, turn, view', 'per')}), corp AS ({f_beta('view', 's')})
    SELECT 'n_pairs' AS name, CAST(count(*) AS DOUBLE) AS value FROM mt UNION ALL SELECT 'mean_chrf_' || view, round(avg(chrf), 2) FROM sent GROUP BY view UNION ALL SELECT 'corpus_chrf_' || view, round(chrf, 2) FROM corp""")
def _(t):
    return cp.mt_summary(_mt(t), IDS, _views())


@query("e3_bleu", f"""
    WITH p AS (SELECT *, conv_id % 3 AS grp, {q.words('hyp')} AS hw, {q.words('ref')} AS rw FROM @pairs), g AS ({word_counts('p', 'conv_id, turn, grp', 'hw', 'rw', 4)}),
    s AS (SELECT k AS "group", n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM (SELECT *, unnest([CAST(grp AS VARCHAR), 'ALL']) AS k FROM g) GROUP BY ALL),
    f AS (SELECT "group", avg(ln(m / CAST(h AS DOUBLE))) FILTER (WHERE m > 0) AS p, count(*) FILTER (WHERE m > 0) AS k, max(h) FILTER (WHERE n = 1) AS hl, max(r) FILTER (WHERE n = 1) AS rl FROM s GROUP BY "group")
    SELECT "group", round(CASE WHEN k = 4 THEN CASE WHEN hl >= rl THEN 1e0 ELSE exp(1e0 - rl / CAST(hl AS DOUBLE)) END * exp(p) ELSE 0e0 END, 6) AS bleu, CAST(hl AS BIGINT) AS hyp_length, CAST(rl AS BIGINT) AS ref_length FROM f""")
def _(t):
    return cp.bleu(t.pairs.withColumn("grp", F.col("conv_id") % 3), IDS, "hyp", "ref", ["grp"])


@query("e4_gleu", f"""
    WITH p AS (SELECT conv_id, turn, {q.words('hyp')} AS hw, {q.words('ref')} AS rw FROM @pairs), g AS ({word_counts('p', 'conv_id, turn', 'hw', 'rw', 4)})
    SELECT conv_id, turn, round(sum(least(h, r)) / CAST(greatest(sum(h), sum(r)) AS DOUBLE), 6) AS gleu FROM g GROUP BY conv_id, turn""")
def _(t):
    return cp.gleu(t.pairs, IDS, "hyp", "ref")


_RW = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query("e5_rouge_1", f"""
    WITH p AS (SELECT conv_id, turn, {_RW.format('hyp')} AS hw, {_RW.format('ref')} AS rw FROM @pairs), g AS ({word_counts('p', 'conv_id, turn', 'hw', 'rw', 1)}),
    s AS (SELECT conv_id, turn, round(2e0 * sum(least(h, r)) / sum(h + r), 6) AS rouge1 FROM g GROUP BY conv_id, turn)
    SELECT p.conv_id, p.turn, coalesce(rouge1, 0e0) AS rouge1 FROM p LEFT JOIN s ON p.conv_id = s.conv_id AND p.turn = s.turn""")
def _(t):
    return cp.rouge_1(t.pairs, IDS, "hyp", "ref")


@query("e5_rouge_l")
def _(t):
    return cp.rouge_l(t.pairs, IDS, "hyp", "ref")


@query("e6_cider", f"""
    WITH p AS (SELECT conv_id, turn, {q.words('lower(hyp)')} AS hw, {q.words('lower(ref)')} AS rw FROM @pairs), g AS ({word_counts('p', 'conv_id, turn', 'hw', 'rw', 4)}),
    d AS (SELECT gram, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, gram FROM g WHERE r > 0) GROUP BY gram), k AS (SELECT ln(CAST(count(*) AS DOUBLE)) AS n FROM p),
    w AS (SELECT conv_id, turn, g.n, h, r, h * (k.n - ln(CAST(greatest(coalesce(df, 1), 1) AS DOUBLE))) AS vh, r * (k.n - ln(CAST(greatest(coalesce(df, 1), 1) AS DOUBLE))) AS vr FROM g LEFT JOIN d ON g.gram = d.gram, k),
    o AS (SELECT conv_id, turn, n, sum(least(vh, vr) * vr) AS dot, sqrt(sum(vh * vh)) AS nh, sqrt(sum(vr * vr)) AS nr, sum(h) AS lh, sum(r) AS lr FROM w GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(CASE WHEN nh * nr > 0 THEN dot / (nh * nr) ELSE 0 END) / 4 AS c, coalesce(max(lh) FILTER (WHERE n = 2), 0) - coalesce(max(lr) FILTER (WHERE n = 2), 0) AS gap FROM o GROUP BY conv_id, turn)
    SELECT conv_id, turn, round(c * exp(-(gap * gap) / 72e0) * 10, 6) AS cider FROM s""")
def _(t):
    return cp.cider(t.pairs.withColumn("refs", F.array("ref")), IDS, "hyp", "refs")


_REF_PAIRS = f"(SELECT conv_id, turn, k, {q.words('lower(hyp)')} AS hw, {q.words('lower(r)')} AS rw FROM (SELECT conv_id, turn, hyp, 0 AS k, ref AS r FROM @pairs UNION ALL SELECT conv_id, turn, hyp, 1, hyp || ' and ' || left(ref, 40) FROM @pairs))"


@query("e6_cider_references", f"""
    WITH p AS {_REF_PAIRS}, g AS ({word_counts('p', 'conv_id, turn, k', 'hw', 'rw', 4)}),
    d AS (SELECT gram, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, gram FROM g WHERE r > 0) GROUP BY gram), z AS (SELECT ln(CAST(count(*) AS DOUBLE) / 2) AS n FROM p),
    w AS (SELECT conv_id, turn, k, g.n, h, r, h * (z.n - ln(CAST(coalesce(df, 1) AS DOUBLE))) AS vh, r * (z.n - ln(CAST(coalesce(df, 1) AS DOUBLE))) AS vr FROM g LEFT JOIN d ON g.gram = d.gram, z),
    o AS (SELECT conv_id, turn, k, n, sum(least(vh, vr) * vr) AS dot, sqrt(sum(vh * vh)) AS nh, sqrt(sum(vr * vr)) AS nr, sum(h) AS lh, sum(r) AS lr FROM w GROUP BY ALL),
    s AS (SELECT conv_id, turn, k, sum(CASE WHEN nh * nr > 0 THEN dot / (nh * nr) ELSE 0 END) / 4 AS c, coalesce(max(lh) FILTER (WHERE n = 2), 0) - coalesce(max(lr) FILTER (WHERE n = 2), 0) AS gap FROM o GROUP BY conv_id, turn, k)
    SELECT conv_id, turn, round(avg(c * exp(-(gap * gap) / 72e0)) * 10, 6) AS cider FROM s GROUP BY conv_id, turn""")
def _(t):
    refs = F.array(F.col("ref"), F.concat(F.col("hyp"), F.lit(" and "), F.substring("ref", 1, 40)))
    return cp.cider(t.pairs.withColumn("refs", refs), IDS, "hyp", "refs")


_OCR = "list_filter(string_split(lower(trim(regexp_replace(regexp_replace(translate({}, chr(9) || chr(10), '  '), '###|\\*\\*\\*', '', 'g'), ' +', ' ', 'g'), ' ')), ' '), lambda w: w <> '')"


@query("e7_ocr_token_prf", f"""
    WITH p AS (SELECT conv_id * 100 + turn AS file, {_OCR.format('hyp')} AS hw, {_OCR.format('ref')} AS rw FROM @pairs), g AS ({word_counts('p', 'file', 'hw', 'rw', 1)}),
    f AS (SELECT file, sum(h) AS pn, sum(r) AS gn, sum(least(h, r)) AS k FROM g GROUP BY file), x AS (SELECT *, k / (gn + 1e-9) AS r, k / (pn + 1e-9) AS p FROM f),
    s AS (SELECT count(*) AS n, sum(r) AS r, sum(p) AS p, sum(2 * r * p / (r + p + 1e-9)) AS f, sum(k) AS k, sum(gn) AS gn, sum(pn) AS pn FROM x),
    m AS (SELECT *, k / (gn + 1e-9) AS mr, k / (pn + 1e-9) AS mp FROM s)
    SELECT round(r / (n + 1e-9), 6) AS macro_recall, round(p / (n + 1e-9), 6) AS macro_precision, round(f / (n + 1e-9), 6) AS macro_f1, round(mr, 6) AS micro_recall, round(mp, 6) AS micro_precision, round(2 * mr * mp / (mr + mp + 1e-9), 6) AS micro_f1 FROM m""")
def _(t):
    return cp.ocr_token_prf(t.pairs.select((F.col("conv_id") * 100 + F.col("turn")).alias("file"), "ref", "hyp"), "file", "ref", "hyp")


_KIE = """rows_ AS (SELECT o_orderkey AS file, 'head.status' AS field, o_orderstatus AS value, 1 AS p, 0 AS t FROM orders UNION ALL SELECT o_orderkey, 'head.status', CASE WHEN o_custkey % 4 = 0 THEN 'X' ELSE o_orderstatus END, 0, 1 FROM orders
      UNION ALL SELECT o_orderkey, 'items', 'i' || o_orderkey % 3, 1, 0 FROM orders UNION ALL SELECT o_orderkey, 'items', 'i' || o_custkey % 3, 1, 0 FROM orders
      UNION ALL SELECT o_orderkey, 'items', 'i' || o_orderkey % 3, 0, 1 FROM orders UNION ALL SELECT o_orderkey, 'items', 'i1', 0, 1 FROM orders
      UNION ALL SELECT o_orderkey, 'note', o_orderpriority, 0, 1 FROM orders WHERE o_orderkey % 5 = 0),
    c AS (SELECT file, field, value, least(sum(p), sum(t)) AS tp, abs(sum(p) - sum(t)) AS miss FROM rows_ GROUP BY ALL)"""


def _kie(t):
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    num = lambda c: F.concat(F.lit("i"), (F.col(c) % 3).cast("string"))
    shape = lambda status, items, note: F.concat(F.lit('{"head": {"status": '), quote(status), F.lit('}, "items": ['), F.concat_ws(", ", *map(quote, items)), F.lit("]"), note, F.lit("}"))
    pred = shape(F.col("o_orderstatus"), [num("o_orderkey"), num("o_custkey")], F.lit(""))
    status = F.when(F.col("o_custkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus"))
    note = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(', "note": '), quote(F.col("o_orderpriority")))).otherwise("")
    truth = shape(status, [num("o_orderkey"), F.lit("i1")], note)
    files = cp.with_field_values(t.orders.select(F.col("o_orderkey").alias("file"), pred.alias("p"), truth.alias("t")), ["p", "t"])
    return cp.kie_counts(files, "file", "p", "t")


@query("e8_kie_field_f1", f"""WITH {_KIE}, f AS (SELECT field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(miss) AS BIGINT) AS errors FROM c GROUP BY field)
    SELECT field, tp, errors, round(tp / (tp + errors / 2 + 1e-6), 6) AS acc FROM f UNION ALL SELECT 'OVERALL', CAST(sum(tp) AS BIGINT), CAST(sum(errors) AS BIGINT), round(sum(tp) / (sum(tp) + sum(errors) / 2 + 1e-6), 6) FROM f""")
def _(t):
    return cp.kie_field_f1(_kie(t))


@query("e8_kie_worst_files", f"""WITH {_KIE} SELECT file, CAST(sum(miss) AS BIGINT) AS errors FROM c GROUP BY file HAVING sum(miss) > 0""")
def _(t):
    return cp.kie_worst_files(_kie(t), "file")


# DuckDB's edit distance counts bytes: its twins give every character outside ASCII a byte of its own, of those that no text holds
_SPARE = "[1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 127]"


def _units(*sources: str) -> str:
    """Sub-query (was, now): the characters outside ASCII of some texts and their bytes."""
    texts = " UNION ALL ".join(f"SELECT {c} AS x FROM {t} UNION ALL SELECT lower({c}) FROM {t}" for c, t in (s.split(" of ") for s in sources))
    return f"""(SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') AS was, coalesce(string_agg(chr(CASE WHEN n > len({_SPARE}) THEN error('too many characters') ELSE {_SPARE}[n] END), '' ORDER BY ch), '') AS now
      FROM (SELECT ch, row_number() OVER (ORDER BY ch) AS n FROM (SELECT DISTINCT unnest(string_split(x, '')) AS ch FROM ({texts})) WHERE ch > '~'))"""


def _distance(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, was, now), translate({b}, was, now))"


def _sides(t):
    return t.pairs.select("conv_id", "turn", F.col("ref").alias("gt"), F.col("hyp").alias("pred"))


_PAIRED = f"(SELECT conv_id, turn, ref AS gt, hyp AS pred, was, now FROM @pairs, {_units('ref of @pairs', 'hyp of @pairs')})"
_SAMPLES = f"(SELECT *, {_distance('gt', 'pred')} AS edits, greatest(length(gt), length(pred)) AS upper_len FROM {_PAIRED})"


@query("e9_edit_distance_pages", f"""
    SELECT round(avg(d), 6) AS edit_dist, count(*) AS pages FROM (SELECT conv_id, sum(edits) / CAST(sum(upper_len) AS DOUBLE) AS d FROM {_SAMPLES} GROUP BY conv_id)""")
def _(t):
    return cp.edit_distance_pages(_sides(t), "conv_id", "gt", "pred")


@query("e9_page_attribute_report", f"""
    WITH s AS (SELECT *, edits / CAST(upper_len AS DOUBLE) AS d, CASE WHEN length(gt) > length(pred) THEN 1e0 ELSE 0e0 END AS longer FROM {_SAMPLES}),
    r AS (SELECT conv_id, upper_len AS w, unnest(['ALL', 'page: ' || conv_id % 4, 'side: ' || turn % 2]) AS attribute, d, longer FROM s),
    p AS (SELECT attribute, conv_id, sum(d * w) / sum(w) AS e, avg(longer) AS l FROM r GROUP BY attribute, conv_id)
    SELECT 'Edit_dist' AS metric, attribute, round(avg(e), 6) AS value, count(*) AS pages FROM p GROUP BY attribute UNION ALL SELECT 'longer', attribute, round(avg(l), 6), count(*) FROM p GROUP BY attribute""")
def _(t):
    s = cp.edit_samples(_sides(t), "gt", "pred")
    attributes = F.array(F.create_map(F.lit("page"), (F.col("conv_id") % 4).cast("string"), F.lit("side"), (F.col("turn") % 2).cast("string")))
    metric = F.create_map(F.lit("Edit_dist"), F.col("edit_dist"), F.lit("longer"), F.when(F.length("gt") > F.length("pred"), 1.0).otherwise(0.0))
    return cp.page_attribute_report(s.withColumns({"attributes": attributes, "metric": metric}), "conv_id", "attributes", "metric", "upper_len")


def _annotated(t):
    attributes = F.array(F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), F.when(F.col("n_chars") > 1500, "long").otherwise("short")),
                         F.create_map(F.lit("lang"), F.col("lang"), F.lit("src"), F.col("source")))
    metric = F.create_map(F.lit("chars"), (F.col("n_chars") % 100).cast("double"), F.lit("even"), (F.col("doc_id") % 2).cast("double"))
    return t.documents.select("doc_id", attributes.alias("attributes"), metric.alias("metric"))


@query("e10_attribute_label_means", """
    WITH l AS (SELECT unnest(['lang: ' || lang, 'size: ' || CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END, 'src: ' || source]) AS label, n_chars % 100 AS chars, doc_id % 2 AS even FROM documents)
    SELECT label, 'chars' AS metric, round(avg(chars), 6) AS value, count(*) AS n FROM l GROUP BY label UNION ALL SELECT label, 'even', round(avg(even), 6), count(*) FROM l GROUP BY label""")
def _(t):
    return cp.attribute_label_means(_annotated(t), "attributes", "metric")


@query("e11_filter_groups", """
    SELECT 'all' AS "group", count(*) AS n, CAST(sum(n_chars % 100) AS DOUBLE) AS chars FROM documents
    UNION ALL SELECT 'english', count(*), CAST(sum(n_chars % 100) AS DOUBLE) FROM documents WHERE lang = 'en' UNION ALL SELECT 'french', count(*), CAST(sum(n_chars % 100) AS DOUBLE) FROM documents WHERE lang = 'fr'""")
def _(t):
    groups = {"english": {"lang": "en"}, "french": {"lang": "fr"}, "french long": {"lang": "fr", "size": "long"}}
    return cp.filter_groups(_annotated(t), "attributes", groups).groupBy("group").agg(
        F.count("*").alias("n"), F.sum(F.element_at("metric", F.lit("chars"))).alias("chars"))


@query("e12_best_ngram_window", f"""
    WITH p AS (SELECT conv_id, turn, was, now, {q.words('gt')} AS nw, {q.words('pred')} AS hw FROM {_PAIRED}),
    w AS (SELECT conv_id, turn, was, now, nw, i, hw[i:i + len(nw) - 1] AS win FROM (SELECT *, unnest(range(1, greatest(len(hw) - len(nw), 0) + 2)) AS i FROM p) WHERE i + len(nw) - 1 <= len(hw)),
    s AS (SELECT conv_id, turn, nw, i, win, 1 - {_distance("array_to_string(win, ' ')", "array_to_string(nw, ' ')")} / CAST(greatest(length(array_to_string(win, ' ')), length(array_to_string(nw, ' '))) AS DOUBLE) AS sim FROM w WHERE list_has_any(win, nw)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sim DESC, i) AS rn FROM s) WHERE rn = 1),
    x AS (SELECT p.conv_id, p.turn, p.nw, win, sim, len(list_intersect(list_distinct(win), list_distinct(p.nw))) / CAST(len(list_distinct(win)) AS DOUBLE) AS pr, len(list_intersect(list_distinct(win), list_distinct(p.nw))) / CAST(len(list_distinct(p.nw)) AS DOUBLE) AS re FROM p LEFT JOIN b ON p.conv_id = b.conv_id AND p.turn = b.turn)
    SELECT conv_id, turn, coalesce(array_to_string(win, ' '), '') AS "window", round(coalesce(sim, 0), 6) AS similarity, round(coalesce(pr, 0), 6) AS precision, round(coalesce(re, 0), 6) AS recall, round(coalesce(2 * pr * re / (pr + re), 0), 6) AS f1,
      round(coalesce(len(list_intersect(list_distinct(win), list_distinct(nw))) / CAST(len(list_distinct(list_concat(win, nw))) AS DOUBLE), 0), 6) AS jaccard, CASE WHEN win = nw THEN 1e0 ELSE 0e0 END AS exact,
      round(coalesce(2e0 * list_sum(list_transform(list_distinct(nw), lambda y: least(len(list_filter(win, lambda z: z = y)), len(list_filter(nw, lambda z: z = y))))) / (len(win) + len(nw)), 0), 6) AS rouge1 FROM x""")
def _(t):
    best = cp.best_windows(_sides(t), IDS, "gt", "pred")
    return best.select("conv_id", "turn", "window", *[F.round(c, 6).alias(c) for c in ("similarity", "precision", "recall", "f1", "jaccard", "rouge1")], "exact")


_TEXT = "trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_BLOCKS = f"""b AS (SELECT page_id, list_transform(regexp_extract_all(h, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: {_TEXT}) AS g, list_transform(regexp_extract_all(h, '(?s)<li(?:\\s[^>]*)?>(.*?)</li>', 1), lambda x: {_TEXT}) AS p
    FROM (SELECT page_id, html AS h FROM pages))"""


def _blocks(t):
    part = lambda tag: F.transform(all_found(F.col("h"), rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), inner_text)
    return t.pages.select("page_id", F.col("html").alias("h")).select("page_id", part("p").alias("g"), part("li").alias("p"))


@query("e13_align_blocks", f"""
    WITH {_BLOCKS}, gg AS (SELECT page_id, unnest(g) AS gt, generate_subscripts(g, 1) - 1 AS i FROM b), pp AS (SELECT page_id, unnest(p) AS pred, generate_subscripts(p, 1) - 1 AS j FROM b),
    c AS (SELECT gg.page_id, i, j, gt, pred, coalesce({_distance('gt', 'pred')} / CAST(nullif(greatest(length(gt), length(pred)), 0) AS DOUBLE), 0e0) AS d FROM gg JOIN pp ON gg.page_id = pp.page_id, {_units('html of pages')}),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, i ORDER BY d, j) AS a, row_number() OVER (PARTITION BY page_id, j ORDER BY d, i) AS z FROM c),
    m AS (SELECT * FROM r WHERE a = 1 AND z = 1)
    SELECT page_id, CAST(i AS INT) AS gt_position, CAST(j AS INT) AS pred_position, md5(gt) AS gt, md5(pred) AS pred, round(d, 6) AS distance FROM m
    UNION ALL SELECT page_id, CAST(i AS INT), NULL, md5(gt), md5(''), 1e0 FROM gg WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = gg.page_id AND m.i = gg.i)
    UNION ALL SELECT page_id, NULL, CAST(j AS INT), md5(''), md5(pred), 1e0 FROM pp WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = pp.page_id AND m.j = pp.j)""")
def _(t):
    out = cp.align_blocks(_blocks(t), "g", "p")
    return out.select("page_id", "gt_position", "pred_position", F.md5("gt").alias("gt"), F.md5("pred").alias("pred"), F.round("distance", 6).alias("distance"))


@query("e13_align_blocks_rounds")
def _(t):
    out = cp.align_blocks(_blocks(t), "g", "p", rounds=None)
    return out.groupBy("page_id").agg(F.count("gt_position").alias("gts"), F.count("pred_position").alias("preds"), F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("distance"))


def _vectors(t):
    e = t.embeddings
    return e.select("vec_id", F.col("embedding").alias("hyp")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("ref")), "vec_id")


_COS = """c AS (SELECT a.vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))) AS s
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@query("e14_embedding_score", f"WITH {_COS} SELECT vec_id, round(s, 6) AS score FROM c")
def _(t):
    return cp.embedding_score(_vectors(t), "hyp", "ref", ["vec_id"])[0]


@query("e14_embedding_system", f"WITH {_COS} SELECT round(avg(round(s, 6)), 4) AS system, count(s) AS n FROM c")
def _(t):
    return cp.embedding_score(_vectors(t), "hyp", "ref", ["vec_id"])[1]


@query("e15_reading_order_distance", f"""
    WITH {_BLOCKS}, m AS (SELECT page_id, i, CASE WHEN (i + page_id) % 5 > 0 THEN (i * 3 + page_id) % 7 END AS j FROM (SELECT page_id, generate_subscripts(p, 1) - 1 AS i FROM b)),
    o AS (SELECT page_id, string_agg(chr(CAST(33 + i AS INT)), '' ORDER BY i) AS g, coalesce(string_agg(chr(CAST(33 + i AS INT)), '' ORDER BY j, i) FILTER (WHERE j IS NOT NULL), '') AS s FROM m GROUP BY page_id)
    SELECT page_id, round(levenshtein(g, s) / CAST(greatest(length(g), length(s)) AS DOUBLE), 6) AS distance FROM o""")
def _(t):
    spot = lambda x, i: F.struct(i.cast("bigint").alias("gt_position"), F.when((i + F.col("page_id")) % 5 > 0, (i * 3 + F.col("page_id")) % 7).alias("pred_position"))
    rows = _blocks(t).select("page_id", F.transform("p", spot).alias("m")).filter(F.size("m") > 0)
    return rows.select("page_id", F.round(cp.reading_order_distance(F.col("m")), 6).alias("distance"))


_REFS = f"""r AS (SELECT conv_id, turn, -1 AS side, hyp AS text FROM @pairs UNION ALL SELECT conv_id, turn, 0, ref FROM @pairs UNION ALL SELECT conv_id, turn, 1, upper(left(ref, 1)) || substr(hyp, 2) FROM @pairs),
    w AS (SELECT conv_id, turn, side, {q.words('text')} AS w FROM r),
    l AS (SELECT conv_id, turn, max(len(w)) FILTER (WHERE side = -1) AS h, list(len(w)) FILTER (WHERE side >= 0) AS refs FROM w GROUP BY ALL),
    z AS (SELECT sum(h) AS hl, sum(list_sort(list_transform(refs, lambda x: [abs(x - h), x]))[1][2]) AS rl FROM l),
    c AS (SELECT conv_id, turn, side, n, gram, count(*) AS c FROM (SELECT conv_id, turn, side, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM w, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
    b AS (SELECT n, coalesce(max(c) FILTER (WHERE side = -1), 0) AS h, coalesce(max(c) FILTER (WHERE side >= 0), 0) AS r FROM c GROUP BY conv_id, turn, n, gram),
    s AS (SELECT n, sum(h) AS h, sum(least(h, r)) AS m FROM b GROUP BY n),
    o AS (SELECT k.k, avg(ln(m / CAST(h AS DOUBLE))) FILTER (WHERE m > 0) AS p, count(*) FILTER (WHERE m > 0) AS seen FROM s JOIN (SELECT unnest([1, 2, 3, 4]) AS k) k ON s.n <= k.k GROUP BY k.k)"""


@query("e3_bleu_references", f"""WITH {_REFS}
    SELECT 'bleu_' || k AS metric, round(CASE WHEN seen = k THEN CASE WHEN hl >= rl THEN 1e0 ELSE exp(1e0 - rl / CAST(hl AS DOUBLE)) END * exp(p) ELSE 0e0 END, 6) AS value FROM o, z""")
def _(t):
    second = F.concat(F.upper(F.substring("ref", 1, 1)), F.substring("hyp", 2, 2147483647))
    return cp.bleu_references(t.pairs.select(*IDS, "hyp", F.array(F.col("ref"), second).alias("refs")), IDS, "hyp", "refs")


@query("e5_rouge_l_references")
def _(t):
    refs = F.array(F.col("ref"), F.concat_ws(" ", F.slice(F.split("ref", " "), 1, 12), F.lit("and more")))
    return cp.rouge_l_references(t.pairs.select(*IDS, "hyp", refs.alias("refs")), IDS, "hyp", "refs")


@query("e5_rouge_l_corpus")
def _(t):
    return cp.corpus_mean(cp.rouge_l(t.pairs, IDS, "hyp", "ref"), "rouge_l")
