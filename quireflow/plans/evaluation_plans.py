"""Evaluation queries: text, boxes, trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.functions import shaping, text
from quireflow.operators import evaluation as ev
from quireflow.plans import inputs as i
from quireflow.plans.registry import query

# The oracle's distance counts bytes. Every distinct element of a pair therefore becomes one
# ASCII character of its own; enough while a pair has at most 127 distinct elements.
_AS_ASCII = "array_to_string(list_transform({items}, lambda e: chr(list_position({known}, e)::INT)), '')"


def _words(column: str) -> str:
    return f"(CASE WHEN {column} = '' THEN [] ELSE string_split({column}, ' ') END)"


def _text_metrics_sql(source: str) -> str:
    return f"""
WITH p AS ({source}),
c AS (SELECT *, list_distinct(list_concat(string_split(ref, ''), string_split(hyp, ''))) AS kc, list_distinct(list_concat({_words('ref')}, {_words('hyp')})) AS kw FROM p),
d AS (SELECT *, levenshtein({_AS_ASCII.format(items="string_split(ref, '')", known='kc')}, {_AS_ASCII.format(items="string_split(hyp, '')", known='kc')}) AS char_edits,
  levenshtein({_AS_ASCII.format(items=_words('ref'), known='kw')}, {_AS_ASCII.format(items=_words('hyp'), known='kw')}) AS word_edits FROM c)
SELECT pair_id, char_edits, word_edits, length(ref) AS ref_chars, length(hyp) AS hyp_chars, len({_words('ref')}) AS ref_words, len({_words('hyp')}) AS hyp_words,
  round(char_edits / greatest(length(ref), 1), 6) AS cer, round(word_edits / greatest(len({_words('ref')}), 1), 6) AS wer FROM d"""


def _metric_columns(df):
    return df.select("pair_id", "char_edits", "word_edits", "ref_chars", "hyp_chars", "ref_words", "hyp_words",
                     F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@query("v1_text_metrics", _text_metrics_sql(i.text_pairs_sql("benchmark", "item_id")))
def text_metrics(spark, sf):
    return _metric_columns(ev.text_metrics(i.text_pairs(spark, sf, "benchmark", "item_id")))


@query("v1_document_metrics")
def document_metrics(spark, sf):
    """Whole documents of any length; checked against brute force in the tests, as the oracle's
    distance is too slow on the longest ones."""
    return _metric_columns(ev.text_metrics(i.text_pairs(spark, sf, "documents", "doc_id")))


_PAGE_CHARS = 200


@query("v1_page_metrics", _text_metrics_sql(f"""
SELECT pair_id * 1000 + k AS pair_id, trim(substr(ref, k * {_PAGE_CHARS} + 1, {_PAGE_CHARS})) AS ref, trim(substr(hyp, k * {_PAGE_CHARS} + 1, {_PAGE_CHARS})) AS hyp
FROM (SELECT *, unnest(range(0, (greatest(length(ref), length(hyp)) + {_PAGE_CHARS - 1}) // {_PAGE_CHARS})) AS k FROM ({i.text_pairs_sql("documents", "doc_id")}))"""))
def page_metrics(spark, sf):
    """All texts of the documents, page by page: short enough for the oracle's distance."""
    pages = F.ceil(F.greatest(F.length("ref"), F.length("hyp")) / _PAGE_CHARS)
    cut = i.text_pairs(spark, sf, "documents", "doc_id").withColumn("n", pages).filter("n > 0") \
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    part = lambda c: F.trim(F.substring(c, F.col("k") * _PAGE_CHARS + 1, F.lit(_PAGE_CHARS)))
    return _metric_columns(ev.text_metrics(cut.select((F.col("pair_id") * 1000 + F.col("k")).alias("pair_id"), part("ref").alias("ref"), part("hyp").alias("hyp"))))


@query("f1_name_distances", """
SELECT p_partkey, levenshtein(p_name, p_brand || ' ' || p_type) AS distance FROM part""")
def name_distances(spark, sf):
    return i.table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", F.concat_ws(" ", "p_brand", "p_type")).alias("distance"))


@query("f2_word_distances", """
WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS a, string_split(p_type || ' ' || p_name || ' ' || p_brand, ' ') AS b FROM part),
k AS (SELECT *, list_distinct(list_concat(a, b)) AS k FROM p)
SELECT p_partkey, levenshtein(array_to_string(list_transform(a, lambda e: chr(64 + list_position(k, e)::INT)), ''), array_to_string(list_transform(b, lambda e: chr(64 + list_position(k, e)::INT)), '')) AS distance FROM k""")
def word_distances(spark, sf):
    a, b = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " "), F.split(F.concat_ws(" ", "p_type", "p_name", "p_brand"), " ")
    return i.table(spark, sf, "part").select("p_partkey", text.word_distance(a, b).alias("distance"))


@query("f3_text_streams", i.with_inputs("layout", f"""
SELECT pair_id, side, {i.collapse_sql("coalesce(string_agg(text, ' ' ORDER BY pre) FILTER (WHERE text <> ''), '')")} AS stream FROM layout GROUP BY ALL""", recursive=True))
def text_streams(spark, sf):
    return ev.text_streams(i.tree_nodes(spark, sf), i.trees_together(spark, sf))


@query("f3_collapsed_documents", f"SELECT doc_id, md5({i.collapse_sql('text')}) AS stream_md5 FROM documents")
def collapsed_documents(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", F.md5(text.collapse_spaces(F.col("text"))).alias("stream_md5"))


@query("c5_paired_documents", """
WITH t AS (SELECT doc_id AS pair_id, n_chars FROM documents), p AS (SELECT doc_id AS pair_id, quality FROM labels)
SELECT pair_id, n_chars, quality, CASE WHEN n_chars IS NULL THEN 'pred_only' WHEN quality IS NULL THEN 'truth_only' ELSE 'paired' END AS state FROM t FULL JOIN p USING (pair_id)""")
def paired_documents(spark, sf):
    truth = i.table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), "n_chars")
    return ev.pair_documents(i.table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), "quality"), truth)


# --- boxes -----------------------------------------------------------------------------------------

@query("f4_line_iou", i.with_inputs("lines", """
SELECT job_id, page_idx, round(i / (2 * w * 15.0::DOUBLE - i), 9) AS iou FROM (SELECT job_id, page_idx, 50.0::DOUBLE + l_quantity AS w, greatest(0.0::DOUBLE, 50.0::DOUBLE + l_quantity - l_suppkey % 9) * 15.0::DOUBLE AS i FROM lines)"""))
def line_iou(spark, sf):
    box = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), (50.0 + F.col("l_quantity")).alias("w"), F.lit(15.0).alias("h"))
    return i.lines(spark, sf).select("job_id", "page_idx", F.round(shaping.iou(box(F.lit(0.0)), box((F.col("l_suppkey") % 9).cast("double"))), 9).alias("iou"))


@query("c4_box_candidates", i.with_inputs("candidates", """
SELECT pair_id, pred_idx, truth_idx, pred_type, truth_type, round(iou, 9) AS iou FROM candidates"""))
def box_candidates(spark, sf):
    return ev.box_candidates(i.boxes(spark, sf)).select("pair_id", "pred_idx", "truth_idx", "pred_type", "truth_type", F.round("iou", 9).alias("iou"))


_GREEDY = """
k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY iou DESC, pred_idx, truth_idx) AS rn FROM candidates),
g AS (
  SELECT pair_id, 0::BIGINT AS rn, []::INT[] AS up, []::INT[] AS ut, 0 AS matched, 0 AS hits, 0 AS same, 0.0::DOUBLE AS total FROM k WHERE rn = 1
  UNION ALL
  SELECT k.pair_id, k.rn, CASE WHEN free THEN list_append(up, pred_idx) ELSE up END, CASE WHEN free THEN list_append(ut, truth_idx) ELSE ut END, matched + free::INT,
    hits + (free AND iou >= 0.5)::INT, same + (free AND iou >= 0.5 AND pred_type = truth_type)::INT, total + CASE WHEN free THEN iou ELSE 0 END
  FROM (SELECT k.*, up, ut, matched, hits, same, total, NOT list_contains(up, pred_idx) AND NOT list_contains(ut, truth_idx) AS free FROM g JOIN k ON k.pair_id = g.pair_id AND k.rn = g.rn + 1) k),
m AS (SELECT pair_id, max(matched) AS matched, max(hits) AS hits, max(same) AS same, max(total) AS total FROM g GROUP BY 1),
n AS (SELECT pair_id, count(*) FILTER (WHERE side = 'pred') AS np, count(*) FILTER (WHERE side = 'truth') AS nt FROM boxes GROUP BY 1),
f AS (SELECT pair_id, np, nt, coalesce(matched, 0) AS matched, coalesce(hits, 0) AS hits, coalesce(same, 0) AS same, coalesce(total, 0) AS total FROM n LEFT JOIN m USING (pair_id)),
s AS (SELECT *, CASE WHEN np > 0 THEN hits / np WHEN nt > 0 THEN 0 ELSE 1 END AS precision, CASE WHEN nt > 0 THEN hits / nt WHEN np > 0 THEN 0 ELSE 1 END AS recall FROM f)
SELECT pair_id, np AS predicted_boxes, nt AS truth_boxes, matched, hits AS matches_at_threshold, 0.5::DOUBLE AS iou_threshold,
  round(CASE WHEN nt > 0 THEN total / nt WHEN np > 0 THEN 0 ELSE 1 END, 6) AS mean_iou, round(CASE WHEN matched > 0 THEN total / matched ELSE 0 END, 6) AS matched_mean_iou,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
  round(CASE WHEN hits > 0 THEN same / hits ELSE 0 END, 6) AS type_accuracy FROM s"""


@query("v2_box_metrics", i.with_inputs("candidates", "WITH " + _GREEDY.strip(), recursive=True))
def box_metrics(spark, sf):
    out = ev.box_metrics(i.boxes(spark, sf), largest_page=i.line_sizes(spark, sf, 2)[1])
    rates = ["mean_iou", "matched_mean_iou", "precision", "recall", "f1", "type_accuracy"]
    return out.withColumns({r: F.round(r, 6) for r in rates})


# --- trees -------------------------------------------------------------------------------------------

@query("e13_reading_order", i.with_inputs("paged", "SELECT pair_id, side, node_id, pre, page FROM paged", recursive=True))
def reading_order(spark, sf):
    return ev.reading_order(i.tree_nodes(spark, sf), [], i.trees_together(spark, sf)).select("pair_id", "side", "node_id", "pre", "page")


@query("o5_sibling_ranks", i.with_inputs("ranked_nodes", "SELECT pair_id, side, node_id, rank FROM ranked_nodes"))
def sibling_ranks(spark, sf):
    """Place of a node among its siblings: ordered ones first, then list position."""
    from quireflow.operators import scan

    nodes = i.tree_nodes(spark, sf).withColumn("_late", F.col("ord").isNull()).withColumn("_key", F.coalesce("ord", F.lit(0)))
    return scan.numbered(nodes, ["pair_id", "side", "parent_id"], ["_late", "_key", "list_pos"], "rank",
                         sizes=i.line_sizes(spark, sf, 4)) \
        .select("pair_id", "side", "node_id", "rank")


@query("e14_post_order", i.with_inputs("sized", """
SELECT pair_id, side, node_id, post, lmld, size, post = max(post) OVER (PARTITION BY pair_id, side, lmld) AS keyroot FROM sized""", recursive=True))
def post_order(spark, sf):
    return ev.post_order(i.tree_nodes(spark, sf), i.trees_together(spark, sf))


@query("v3_tree_admission", i.with_inputs("sized", """
WITH k AS (SELECT pair_id, side, max(post) - lmld + 1 AS size FROM sized GROUP BY pair_id, side, lmld),
c AS (SELECT pair_id, side, sum(size) AS cost FROM k GROUP BY ALL),
r AS (SELECT n.pair_id, n.side, count(*) AS nodes FROM tree_nodes n GROUP BY ALL),
mirrored AS (SELECT *, (row_number() OVER (PARTITION BY pair_id, side ORDER BY mpath) - 1)::INT AS mpre, (row_number() OVER (PARTITION BY pair_id, side ORDER BY list_append(mpath, 2147483647)) - 1)::INT AS mpost
  FROM (SELECT *, list_transform(path, lambda v: -v) AS mpath FROM sized)),
mk AS (SELECT pair_id, side, max(mpost) - l + 1 AS size FROM (SELECT *, mpost - size + 1 AS l FROM mirrored) GROUP BY pair_id, side, l),
mc AS (SELECT pair_id, side, sum(size) AS cost FROM mk GROUP BY ALL),
a AS (SELECT pair_id, max(nodes) FILTER (WHERE side = 'pred') AS pred_nodes, max(nodes) FILTER (WHERE side = 'truth') AS truth_nodes FROM r GROUP BY 1),
s AS (SELECT pair_id, (max(cost) FILTER (WHERE side = 'pred') * max(cost) FILTER (WHERE side = 'truth'))::BIGINT AS straight FROM c GROUP BY 1),
m AS (SELECT pair_id, (max(cost) FILTER (WHERE side = 'pred') * max(cost) FILTER (WHERE side = 'truth'))::BIGINT AS turned FROM mc GROUP BY 1)
SELECT pair_id, pred_nodes, truth_nodes, least(straight, turned) AS cells, turned < straight AS mirrored,
  CASE WHEN greatest(pred_nodes, truth_nodes) > 1000 THEN 'nodes' WHEN least(straight, turned) > 20000000 THEN 'steps' END AS refused_reason
FROM a JOIN s USING (pair_id) JOIN m USING (pair_id)""", recursive=True))
def tree_admission(spark, sf):
    return ev.admission_report(i.tree_nodes(spark, sf), i.trees_together(spark, sf))


@query("v4_tree_distance")
def tree_distance(spark, sf):
    """Of every pair, whatever its size. Checked against the recursive definition on random trees in the tests."""
    return ev.tree_metrics(i.tree_nodes(spark, sf), i.trees_together(spark, sf), **ev.UNLIMITED).withColumn("ted_normalized", F.round("ted_normalized", 6))


@query("v4_flat_trees", i.with_inputs("lines", """
SELECT job_id AS pair_id, levenshtein(string_agg(l_returnflag, '' ORDER BY page_idx),
  coalesce(string_agg(CASE WHEN l_quantity > 40 THEN l_linestatus ELSE l_returnflag END, '' ORDER BY page_idx) FILTER (WHERE l_discount < 0.08), '')) AS ted
FROM lines GROUP BY 1"""))
def flat_trees(spark, sf):
    """A page per order with a leaf per line. Trees of depth one with equal roots are as far apart as
    the sequences of their leaves, which the oracle can compare."""
    leaf = lambda side, kind: F.struct(F.lit(side).alias("side"), (F.col("page_idx") + 1).cast("bigint").alias("node_id"), F.lit(0).cast("bigint").alias("parent_id"), "page_idx", kind.alias("type"))
    root = lambda side: F.struct(F.lit(side).alias("side"), F.lit(0).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("page_idx"), F.lit("page").alias("type"))
    flag, seen = F.col("l_returnflag"), F.when(F.col("l_quantity") > 40, F.col("l_linestatus")).otherwise(F.col("l_returnflag"))
    first = F.col("page_idx") == 0
    rows = i.lines(spark, sf).select(F.col("job_id").alias("pair_id"), F.inline(F.filter(F.array(
        leaf("truth", flag), F.when(F.col("l_discount") < 0.08, leaf("pred", seen)), F.when(first, root("truth")), F.when(first, root("pred"))), lambda n: n.isNotNull())))
    none = F.lit(None).cast("double")
    nodes = rows.select("pair_id", "side", "node_id", "parent_id", F.col("page_idx").cast("int").alias("list_pos"), "type", F.lit(None).cast("string").alias("text"),
                        *[none.alias(n) for n in "xywh"], F.lit(None).cast("int").alias("ord"), none.alias("confidence"))
    return ev.tree_metrics(nodes, **ev.UNLIMITED).select("pair_id", "ted")


@query("v4_segment_trees")
def segment_trees(spark, sf):
    """Trees of market segment > customer, a hundred customers each, against a prediction that loses
    and relabels customers."""
    customer = i.table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 100).alias("pair_id"), "c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    place = F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("segment")).cast("bigint")
    kind = F.concat(F.lit("customer-"), (F.col("c_custkey") % 4).cast("string"))

    def node(side, node_id, parent, pos, type_):
        none = F.lit(None).cast("double")
        return F.struct(F.lit(side).alias("side"), node_id.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"),
                        pos.cast("int").alias("list_pos"), type_.alias("type"), F.lit(None).cast("string").alias("text"),
                        *[none.alias(c) for c in "xywh"], F.lit(None).cast("int").alias("ord"), none.alias("confidence"))

    leaf = F.col("c_custkey") + 100
    relabelled = F.when(F.col("c_acctbal") > 8500, "customer-x").otherwise(kind)
    lost = F.col("c_acctbal") < -500
    leaves = customer.select("pair_id", F.explode(F.array(
        node("truth", leaf, place, F.col("c_custkey"), kind), F.when(~lost, node("pred", leaf, place, F.col("c_custkey"), relabelled)))).alias("n"))
    inner = customer.select("pair_id", "segment").distinct().select("pair_id", F.explode(F.array(*[
        node(s, place, F.lit(0), place, F.col("segment")) for s in ev.SIDES])).alias("n"))
    roots = customer.select("pair_id").distinct().select("pair_id", F.explode(F.array(*[
        node(s, F.lit(0), F.lit(None), F.lit(0), F.lit("page")) for s in ev.SIDES])).alias("n"))
    nodes = leaves.unionByName(inner).unionByName(roots).filter("n is not null").select("pair_id", "n.*")
    return ev.tree_metrics(nodes).withColumn("ted_normalized", F.round("ted_normalized", 6))


@query("v5_evaluate")
def evaluate(spark, sf):
    """All scores of every pair of trees, whatever its size, one row each."""
    out = ev.evaluate(i.tree_nodes(spark, sf), together=i.trees_together(spark, sf), **ev.UNLIMITED)
    rates = ["cer", "wer", "mean_iou", "matched_mean_iou", "precision", "recall", "f1", "type_accuracy", "ted_normalized"]
    return out.withColumns({r: F.round(r, 6) for r in rates})


_SCORES = f"""
WITH boxes AS (SELECT pair_id, page, pre AS idx, side, type, x, y, w, h FROM paged WHERE x IS NOT NULL),
candidates AS (SELECT * FROM (
  SELECT p.pair_id, p.idx AS pred_idx, t.idx AS truth_idx, p.type AS pred_type, t.type AS truth_type, i / (p.w * p.h + t.w * t.h - i) AS iou
  FROM (SELECT p, t, greatest(0.0, least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x)) * greatest(0.0, least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y)) AS i
        FROM boxes p JOIN boxes t ON p.pair_id = t.pair_id AND p.page IS NOT DISTINCT FROM t.page AND p.side = 'pred' AND t.side = 'truth')) WHERE iou > 0),
streams AS (SELECT pair_id, side, {i.collapse_sql("coalesce(string_agg(text, ' ' ORDER BY pre) FILTER (WHERE text <> ''), '')")} AS stream FROM layout GROUP BY ALL),
texts AS (SELECT * FROM ({_text_metrics_sql("SELECT pair_id, max(stream) FILTER (WHERE side = 'truth') AS ref, max(stream) FILTER (WHERE side = 'pred') AS hyp FROM streams GROUP BY 1")})),
found AS (SELECT * FROM (WITH RECURSIVE {_GREEDY.strip()}))
SELECT t.*, f.* EXCLUDE (pair_id) FROM texts t JOIN found f USING (pair_id)"""


@query("v5_text_and_box_scores", i.with_inputs("paged", _SCORES, recursive=True))
def text_and_box_scores(spark, sf):
    """The part of the full evaluation that SQL can express."""
    return evaluate(spark, sf).drop("pred_nodes", "truth_nodes", "refused_reason", "ted", "ted_normalized")


_UNEVEN = """
SELECT * FROM whole_nodes WHERE NOT (side = 'pred' AND pair_id % 11 = 0) AND NOT (side = 'truth' AND pair_id % 13 = 0)
UNION ALL SELECT -1 - job_id // 400, u.side, u.node_id, u.parent_id, u.list_pos, u.type, u.text, NULL, NULL, NULL, NULL, NULL FROM (
  SELECT job_id, unnest(list_filter([
    {'side': 'truth', 'node_id': job_id * 1000 + page_idx + 1, 'parent_id': 0, 'list_pos': (job_id * 1000 + page_idx)::INT, 'type': 'line', 'text': l_linestatus},
    {'side': 'pred', 'node_id': job_id * 1000 + page_idx + 1, 'parent_id': 0, 'list_pos': (job_id * 1000 + page_idx)::INT, 'type': 'line', 'text': CASE WHEN l_quantity > 45 THEN l_returnflag ELSE l_linestatus END},
    CASE WHEN page_idx = 0 AND job_id % 400 = first_id % 400 THEN {'side': 'truth', 'node_id': 0, 'parent_id': NULL, 'list_pos': 0, 'type': 'document', 'text': NULL} END,
    CASE WHEN page_idx = 0 AND job_id % 400 = first_id % 400 THEN {'side': 'pred', 'node_id': 0, 'parent_id': NULL, 'list_pos': 0, 'type': 'document', 'text': NULL} END], lambda v: v IS NOT NULL)) AS u
  FROM (SELECT *, min(job_id) OVER (PARTITION BY job_id // 400) AS first_id FROM lines))"""
_UNEVEN_SCORES = _SCORES.split("SELECT t.*, f.*")[0].replace(
    "max(stream) FILTER (WHERE side = 'truth')", "coalesce(max(stream) FILTER (WHERE side = 'truth'), '')").replace(
    "max(stream) FILTER (WHERE side = 'pred')", "coalesce(max(stream) FILTER (WHERE side = 'pred'), '')") + """
SELECT t.*, coalesce(predicted_boxes, 0) AS predicted_boxes, coalesce(truth_boxes, 0) AS truth_boxes, coalesce(matched, 0) AS matched, coalesce(matches_at_threshold, 0) AS matches_at_threshold,
  coalesce(mean_iou, 1) AS mean_iou, coalesce(precision, 1) AS precision, coalesce(recall, 1) AS recall, coalesce(f1, 1) AS f1, pred_nodes, truth_nodes,
  CASE WHEN least(pred_nodes, truth_nodes) = 0 THEN 'unpaired' WHEN greatest(pred_nodes, truth_nodes) > 1000 THEN 'nodes' END AS refused_reason
FROM texts t LEFT JOIN found f USING (pair_id) JOIN (
  SELECT pair_id, count(*) FILTER (WHERE side = 'pred') AS pred_nodes, count(*) FILTER (WHERE side = 'truth') AS truth_nodes FROM tree_nodes GROUP BY 1) USING (pair_id)"""


@query("v5_unpaired_and_large", i.with_inputs("paged", _UNEVEN_SCORES, recursive=True).replace("tree_nodes AS (", "whole_nodes AS (", 1).replace(
    "ranked_nodes AS (", f"tree_nodes AS ({_UNEVEN}),\nranked_nodes AS (", 1))
def unpaired_and_large(spark, sf):
    """Orders of which some lose a side, and flat trees of the lines of 400 orders each, most of them over
    the node limit: every pair keeps its text and box scores."""
    pair = F.col("pair_id")
    whole = i.tree_nodes(spark, sf).filter(~((F.col("side") == "pred") & (pair % 11 == 0)) & ~((F.col("side") == "truth") & (pair % 13 == 0)))
    together = i.groups_together(spark, sf, _JOBS) and _apart(spark, sf)
    flat = _flat_nodes(spark, sf, together)
    if together:  # neither nodes of orders nor flat trees are shuffled
        out = ev.evaluate(whole, together=i.trees_together(spark, sf)).unionByName(ev.evaluate(flat, together=True))
    else:
        out = ev.evaluate(whole.unionByName(flat))
    rates = ["cer", "wer", "mean_iou", "precision", "recall", "f1"]
    return out.withColumns({r: F.round(r, 6) for r in rates}).drop("iou_threshold", "matched_mean_iou", "type_accuracy", "ted", "ted_normalized")


_JOBS = 400  # orders of a flat tree


def _apart(spark, sf) -> bool:
    """Whether no flat tree has the number of an order: those of flat trees are negative where no order has a negative number or none."""
    key = F.col("l_orderkey")
    return not i.table(spark, sf, "lineitem").filter(key.isNull() | (key < 0)).select(key).head(1)


def _flat_nodes(spark, sf, together):
    """A root and a leaf per line, both sides. ``together``: the nodes of a tree come side by side, as the lines do."""
    none = {"x": "double", "y": "double", "w": "double", "h": "double", "ord": "int", "confidence": "double"}
    place = F.col("job_id") * 1000 + F.col("page_idx")
    seen = F.when(F.col("l_quantity") > 45, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    line = i.lines(spark, sf, group=-1 - F.floor(F.col("job_id") / _JOBS), most_jobs=_JOBS).withColumnRenamed("group_id", "pair_id")

    def node(side, node_id, parent, pos, kind, text):
        return F.struct(F.lit(side).alias("side"), node_id.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"), pos.cast("bigint").alias("list_pos"),
                        F.lit(kind).alias("type"), text.cast("string").alias("text"))

    zero = F.lit(0)
    leaves = [node(side, place + 1, zero, place, "line", text) for side, text in (("truth", F.col("l_linestatus")), ("pred", seen))]
    roots = [node(side, zero, F.lit(None), zero, "document", F.lit(None)) for side in ("truth", "pred")]
    if together:
        first = F.row_number().over(Window.partitionBy("pair_id").orderBy("job_id", "page_idx")) == 1
        nodes = line.withColumn("_first", first).select("pair_id", F.inline(F.filter(F.array(*leaves, *[F.when(F.col("_first"), r) for r in roots]), lambda n: n.isNotNull())))
    else:
        nodes = line.select("pair_id", F.inline(F.array(*leaves)))
        nodes = nodes.unionByName(line.select("pair_id").distinct().select("pair_id", F.inline(F.array(*roots))))
    return nodes.withColumns({n: F.lit(None).cast(t) for n, t in none.items()})
