"""SQL for the queries of the catalog, to be run by DuckDB on the same tables."""

from __future__ import annotations

from facetry.functions.text import REFUSAL_MARKERS, WHITESPACE
from facetry.operators.negatives import FACTOR, LEAST_BITS, PRIME, ROUNDS
from facetry.sources.readers import MISSING_TOKENS

SQL: dict[str, str] = {}

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)

_MISSING = ", ".join(f"'{t}'" for t in MISSING_TOKENS)

_LABELLED = "labelled AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_ITEMS = ("items AS (SELECT d.doc_id AS item_id, d.lang, d.source, e.label, e.embedding "
          "FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)")


def _round(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def _entries(source: str, keys: str, vector: str, digits: int = 6) -> str:
    """One row per entry of a list column, 0-based."""
    return (f"SELECT {keys}, (i - 1)::INT AS pos, {_round('v::DOUBLE', digits)} AS value FROM "
            f"(SELECT {keys}, unnest({vector}) AS v, generate_subscripts({vector}, 1) AS i FROM {source})")


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


# -- sources and sinks ----------------------------------------------------------

SQL["read_items"] = "SELECT doc_id, lang, source, length(text)::BIGINT AS length FROM documents"
SQL["read_items_csv"] = f"""
SELECT doc_id, md5(CASE WHEN text NOT IN ({_MISSING}) THEN text END) AS digest,
       CASE WHEN lang NOT IN ({_MISSING}) THEN lang END AS lang,
       CASE WHEN source NOT IN ({_MISSING}) THEN source END AS source
FROM documents"""
SQL["read_orders_typed"] = """
SELECT o_orderkey::BIGINT AS o_orderkey, o_totalprice::DOUBLE AS o_totalprice, strftime(o_orderdate::DATE + 1, '%Y-%m-%d') AS next_day,
       o_orderstatus, 'bigint,double,date,string' AS kinds FROM orders"""
SQL["sketched_attributes"] = f"""WITH {_LABELLED},
cells AS (SELECT unnest(['doc', 'lang', 'source', 'quality']) AS attribute,
                 unnest([doc_id::VARCHAR, lang, source, quality::VARCHAR]) AS value FROM labelled)
SELECT attribute, count(*) AS n_rows, count(*) - count(value) AS n_missing, true AS "close" FROM cells GROUP BY attribute"""
SQL["read_vectors"] = "SELECT vec_id, len(embedding)::BIGINT AS width FROM embeddings"
SQL["vectors_round_trip"] = _entries("embeddings", "vec_id", "embedding")


def _mapping(source: str, attributes: dict[str, str]) -> str:
    parts = [f"SELECT '{a}' AS attribute, coalesce({c}::VARCHAR, '') AS label FROM {source}" for a, c in attributes.items()]
    return (f"(SELECT attribute, label, (row_number() OVER (PARTITION BY attribute ORDER BY label) - 1)::INT AS idx "
            f"FROM (SELECT DISTINCT attribute, label FROM ({' UNION ALL '.join(parts)})))")


SQL["labels_round_trip"] = f"WITH {_ITEMS} SELECT * FROM {_mapping('items', {'lang': 'lang', 'label': 'label'})}"

# -- cleaning -------------------------------------------------------------------

SQL["drop_stray_columns"] = "SELECT doc_id, lang, source, n_chars FROM documents"
SQL["drop_missing_text"] = f"""WITH {_LABELLED}
SELECT doc_id, source, md5(text) AS digest FROM labelled WHERE quality IS NOT NULL AND text IS NOT NULL"""
SQL["drop_missing_attributes"] = f"""WITH {_LABELLED}
SELECT doc_id, quality, toxic FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL"""
SQL["keep_first_text"] = """
SELECT doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
SQL["keep_first_part_name"] = """
SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1"""
SQL["assign_item_ids"] = """
SELECT event_id, event_type, 'W' || row_number() OVER (ORDER BY event_id) AS id FROM events"""
SQL["clean_items"] = f"""WITH {_LABELLED}, kept AS (
  SELECT * FROM labelled WHERE text IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
SELECT 'W' || row_number() OVER (ORDER BY doc_id) AS id, doc_id, lang, quality, md5(text) AS digest FROM kept"""
SQL["clean_report"] = f"""WITH {_LABELLED}, complete AS (
  SELECT * FROM labelled WHERE text IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL)
SELECT 'initial' AS step, count(*) AS n_rows FROM labelled
UNION ALL SELECT 'with_text', count(text) FROM labelled
UNION ALL SELECT 'complete', count(*) FROM complete
UNION ALL SELECT 'distinct_text', count(DISTINCT text) FROM complete"""
SQL["filter_frequent_values"] = """
SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 100)"""
SQL["filter_frequent_nations"] = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) >= 60)"""
SQL["composite_field"] = """
SELECT c_custkey, r_name || '#####' || n_name AS place FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_MIX = "coalesce(quality::VARCHAR, '') || '#####' || coalesce(lang, '') || '#####' || coalesce(toxic::VARCHAR, '')"
SQL["composite_field_with_nulls"] = f"WITH {_LABELLED} SELECT doc_id, {_MIX} AS mix FROM labelled"
SQL["item_summary"] = f"""WITH {_LABELLED}
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, count(*) AS n_rows, 7::BIGINT AS n_columns, count(DISTINCT {c}) AS n_unique, "
    f"count(*) - count({c}) AS n_missing FROM labelled" for c in ("lang", "source", "quality", "toxic"))
SQL["select_attributes"] = "SELECT doc_id, lang AS language, source FROM documents"
_STRIPPED = f"trim(replace(text, chr(10), ' '), {_BLANKS})"
SQL["clean_text_for_service"] = f"""
SELECT doc_id, md5(CASE WHEN coalesce({_STRIPPED}, '') = '' THEN ' ' ELSE {_STRIPPED} END) AS digest FROM documents"""
SQL["clean_text_for_local"] = f"""
SELECT conv_id, turn, md5(CASE WHEN coalesce(trim(text, {_BLANKS}), '') = '' THEN '' ELSE replace(text, chr(10), ' ') END) AS digest
FROM conversations"""
_NORMAL = f"regexp_replace(trim(replace({_MIX}, '#####', ' '), {_BLANKS}), ' {{2,}}', ' ', 'g')"
SQL["normalise_labels"] = f"WITH {_LABELLED} SELECT doc_id, {_NORMAL} AS label FROM labelled"

# -- labels ---------------------------------------------------------------------

_THREE = {"lang": "lang", "source": "source", "quality": "quality"}
SQL["label_mapping"] = f"WITH {_LABELLED} SELECT * FROM {_mapping('labelled', _THREE)}"
SQL["encode_labels"] = f"""WITH {_LABELLED}
SELECT doc_id, """ + ", ".join(
    f"(dense_rank() OVER (ORDER BY coalesce({c}::VARCHAR, '')) - 1)::INT AS {c}_idx" for c in _THREE) + " FROM labelled"
SQL["decode_labels"] = "SELECT doc_id, source AS source_name FROM documents"
SQL["class_counts"] = f"WITH {_LABELLED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, count(DISTINCT coalesce({c}::VARCHAR, '')) AS n_classes FROM labelled" for c in _THREE)
SQL["align_items_with_vectors"] = f"""WITH {_ITEMS}
SELECT item_id, lang, source, label, len(embedding)::BIGINT AS width FROM items"""
SQL["split_rows"] = """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':42')) <= count(*) OVER () - floor(count(*) OVER () * 0.1)
                    THEN 'train' ELSE 'validation' END AS split
FROM documents"""

# -- vectors --------------------------------------------------------------------

SQL["valid_vectors"] = """
SELECT d.doc_id AS item_id, e.embedding IS NOT NULL AND len(e.embedding) = 64
       AND NOT list_bool_or(list_transform(e.embedding, lambda x: isnan(x))) IS TRUE AS valid
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
SQL["valid_rows"] = f"WITH {_ITEMS} SELECT item_id, lang FROM items WHERE NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))"
SQL["nonzero_anchors"] = "SELECT vec_id, label FROM embeddings WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0))"
SQL["trim_vectors"] = _entries("(SELECT vec_id, embedding[1:16] AS v FROM embeddings)", "vec_id", "v")
SQL["split_vectors"] = " UNION ALL ".join(
    _entries(f"(SELECT vec_id, '{n}' AS block, embedding[{16 * i + 1}:{16 * i + 16}] AS v FROM embeddings)", "vec_id, block", "v")
    for i, n in enumerate(["first", "second", "third", "fourth"]))
SQL["concat_vectors"] = _entries("(SELECT vec_id, embedding[33:64] || embedding[1:32] AS v FROM embeddings)", "vec_id", "v")
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
SQL["normalise_vectors"] = _entries(
    f"(SELECT vec_id, list_transform(embedding, lambda x: x / greatest(n, 1e-12)) AS v FROM "
    f"(SELECT vec_id, embedding, {_NORM.format(v='embedding')} AS n FROM embeddings))", "vec_id", "v")

# -- negatives ------------------------------------------------------------------


def _pools(attributes: list[str]) -> str:
    """Pool sizes straight from the definition, keys against keys."""
    keys = ", ".join(attributes)
    differ = " AND ".join(f"b.{a} <> a.{a}" for a in attributes)
    own = ", ".join(f"a.{a}" for a in attributes)
    return (f"keys AS (SELECT {keys}, count(*) AS n FROM items GROUP BY {keys}), "
            f"pools AS (SELECT {own}, any_value(a.n) AS n, coalesce(sum(b.n), 0)::BIGINT AS pool "
            f"FROM keys a LEFT JOIN keys b ON {differ} GROUP BY {own})")


SQL["negative_pool_sizes"] = f"WITH {_ITEMS}, {_pools(['label', 'lang'])} SELECT label, lang, n, pool FROM pools"
SQL["negative_pool_sizes_three"] = (
    f"WITH {_ITEMS}, {_pools(['label', 'lang', 'source'])} SELECT label, lang, source, n, pool FROM pools")
SQL["item_pool_sizes"] = f"WITH {_ITEMS}, {_pools(['label', 'lang'])} SELECT item_id, pool FROM items JOIN pools USING (label, lang)"
SQL["compatible_keys"] = f"""WITH {_ITEMS}, {_pools(['label', 'lang'])}
SELECT a.label, a.lang, b.label AS other_label, b.lang AS other_lang, b.n FROM keys a JOIN keys b ON a.label <> b.label AND a.lang <> b.lang"""
SQL["brute_force_pool"] = f"""WITH {_ITEMS}, one AS (SELECT * FROM items ORDER BY item_id LIMIT 1)
SELECT items.item_id FROM items, one WHERE items.label <> one.label AND items.lang <> one.lang"""

def _permuted(source: str) -> str:
    """``x`` of ``source`` after the rounds of the permutation, and its other columns (see negatives.permuted)."""
    inner = f"SELECT *, x >> rb AS h0, x & ((1::BIGINT << rb) - 1) AS h1 FROM ({source})"
    for i in range(ROUNDS):
        key = f"(k[{i % 4 + 1}] + {i})"
        inner = f"SELECT * REPLACE ((h{1 - i % 2} + {key}) % {PRIME} AS m) FROM ({inner.replace('SELECT *,', 'SELECT *, 0::BIGINT AS m,', 1) if i == 0 else inner})"
        mask = f"((1::BIGINT << {'rb' if i % 2 else 'lb'}) - 1)"
        inner = f"SELECT * REPLACE (xor(h{i % 2}, ((m * m % {PRIME}) * {FACTOR} + {key}) % {PRIME} & {mask}) AS h{i % 2}) FROM ({inner})"
    return f"SELECT item_id, pool, lb, rb, k, j, h0 << rb | h1 AS x FROM ({inner})"


# The pool of an item in the order of keys and ids; the permutation of 0 .. 8 says which rows of it are drawn.
_SAMPLE = f"""{_ITEMS},
pairs AS (
  SELECT a.item_id, b.item_id AS neg_id, row_number() OVER (PARTITION BY a.item_id ORDER BY b.label::VARCHAR, b.lang, b.item_id) - 1 AS x
  FROM items a JOIN items b ON a.label <> b.label AND a.lang <> b.lang),
anchors AS (
  SELECT item_id, count(*)::BIGINT AS pool, greatest(length(bin(count(*) - 1)), {LEAST_BITS})::BIGINT AS bits,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(md5(item_id || ':42'), i, 8))::BIGINT % {PRIME}) AS k
  FROM pairs GROUP BY item_id HAVING count(*) >= 9),
walk AS (
  {_permuted("SELECT item_id, pool, bits // 2 AS lb, bits - bits // 2 AS rb, k, j, j AS x FROM anchors, (SELECT unnest(range(9)) AS j)")}
  UNION ALL {_permuted("SELECT * FROM walk WHERE x >= pool")}),
sample AS (
  SELECT item_id, 0 AS pos, item_id AS neg_id FROM items
  UNION ALL SELECT item_id, (j + 1)::INT, neg_id FROM walk JOIN pairs USING (item_id, x) WHERE x < pool)"""
SQL["sample_negatives"] = f"WITH RECURSIVE {_SAMPLE} SELECT item_id, pos, neg_id FROM sample"
SQL["negatives_round_trip"] = SQL["sample_negatives"]
SQL["negatives_certificate"] = f"""WITH {_ITEMS}, {_pools(['label', 'lang', 'source'])}
SELECT item_id, 9::BIGINT AS n_slots, 9::BIGINT AS n_distinct, 0::BIGINT AS n_shared FROM items JOIN pools USING (label, lang, source) WHERE pool >= 9"""
SQL["negatives_of_all_documents"] = f"""WITH {_LABELLED},
pools AS (SELECT a.doc_id AS item_id, count(b.doc_id) AS pool FROM labelled a LEFT JOIN labelled b
  ON a.quality IS DISTINCT FROM b.quality AND a.lang <> b.lang AND a.source <> b.source GROUP BY a.doc_id)
SELECT item_id, 9::BIGINT AS n_slots, CASE WHEN pool >= 9 THEN 9 END::BIGINT AS n_distinct, 0::BIGINT AS n_shared FROM pools WHERE pool > 0"""
SQL["anchor_slots"] = f"WITH {_ITEMS} " + _entries("items", "item_id", "embedding")
SQL["gather_negative_vectors"] = f"""WITH RECURSIVE {_SAMPLE},
coded AS (SELECT item_id, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS lang_idx,
                 (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::INT AS label_idx FROM items)
SELECT s.item_id, lang_idx, label_idx, pos, {_round('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS total
FROM sample s JOIN coded c ON c.item_id = s.item_id JOIN items n ON n.item_id = s.neg_id"""
SQL["check_negatives"] = """
SELECT count(*) AS n_items, 10::BIGINT AS slots, count(e.vec_id) AS valid_anchors, count(*) - count(e.vec_id) AS zero_anchors,
       0::BIGINT AS self_slots, 64::BIGINT AS width, count(*) * 10 * 64 * 4 / 1048576.0::DOUBLE AS memory_mb
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""

# -- algebra --------------------------------------------------------------------

SQL["vector_gram"] = f"""
WITH cells AS (SELECT vec_id, generate_subscripts(embedding, 1)::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.i, b.i AS j, {_round('sum(a.v * b.v)')} AS value FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i"""

# Two columns: the inverse of the 2x2 crossproduct is known in closed form.
_TWO = f"""{_ITEMS},
cells AS (SELECT item_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, generate_subscripts(embedding, 1)::INT - 1 AS pos,
                 unnest(embedding)::DOUBLE AS y FROM items),
xx AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM (SELECT item_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM items)),
xy AS (SELECT pos, sum(a * y) AS ya, sum(b * y) AS yb FROM cells GROUP BY pos),
fit AS (SELECT pos, (bb * ya - ab * yb) / (aa * bb - ab * ab) AS wa, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS wb FROM xy, xx),
residuals AS (SELECT item_id, pos::INT AS pos, y, y - a * wa - b * wb AS r FROM cells JOIN fit USING (pos))"""
SQL["projection_residuals"] = f"WITH {_TWO} SELECT item_id, pos, {_round('r')} AS value FROM residuals"
SQL["residual_norms"] = f"""WITH {_TWO}
SELECT count(DISTINCT item_id) AS n, {_round('sqrt(sum(r * r))')} AS residual_norm, {_round('sqrt(sum(y * y))')} AS vector_norm,
       {_round('sqrt(sum(r * r) / sum(y * y))')} AS ratio FROM residuals"""

# One column against three: the residuals have two non-zero columns, so their singular
# values and vectors solve a quadratic.
_NARROW = f"""{_ITEMS},
r0 AS (SELECT item_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM items),
w AS (SELECT sum(a * y) / sum(a * a) AS wy, sum(a * z) / sum(a * a) AS wz FROM r0),
r AS (SELECT item_id, y - a * wy AS y, z - a * wz AS z FROM r0, w),
m AS (SELECT sum(y * y) AS p, sum(y * z) AS q, sum(z * z) AS s FROM r),
e AS (SELECT (p + s) / 2 + sqrt((p - s) * (p - s) / 4 + q * q) AS l1, (p + s) / 2 - sqrt((p - s) * (p - s) / 4 + q * q) AS l2, p, q, s FROM m),
u AS (SELECT l1, l2, q / sqrt(q * q + (l1 - p) * (l1 - p)) AS uy, (l1 - p) / sqrt(q * q + (l1 - p) * (l1 - p)) AS uz FROM e),
f AS (SELECT l1, l2, uy, uz, CASE WHEN (CASE WHEN abs(uy) >= abs(uz) THEN uy ELSE uz END) < 0 THEN -1 ELSE 1 END AS s1,
             CASE WHEN (CASE WHEN abs(uz) >= abs(uy) THEN -uz ELSE uy END) < 0 THEN -1 ELSE 1 END AS s2 FROM u)"""
SQL["nuisance_three_wide"] = f"""WITH {_NARROW}
SELECT item_id, 0 AS pos, {_round('s1 * (y * uy + z * uz)')} AS value FROM r, f
UNION ALL SELECT item_id, 1, {_round('s2 * (z * uy - y * uz)')} FROM r, f"""
SQL["elbow_three_wide"] = f"""WITH {_NARROW}
SELECT 1 AS dim, {_round('sqrt(l1)')} AS singular_value, 0.0::DOUBLE AS diff, {_round('100 * l1 / (l1 + l2)')} AS cumulative_pct FROM f
UNION ALL SELECT 2, {_round('sqrt(l2)')}, {_round('sqrt(l1) - sqrt(l2)')}, 100.0::DOUBLE FROM f"""
_PAIRS = [("lang", "lang"), ("source", "source"), ("label", "label"), ("lang", "source"), ("lang", "label"), ("source", "label")]
SQL["design_pair_counts"] = f"WITH {_ITEMS} " + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute_i, {a}::VARCHAR AS label_i, '{b}' AS attribute_j, {b}::VARCHAR AS label_j, count(*) AS n "
    f"FROM items GROUP BY {a}, {b}" for a, b in _PAIRS)

# One attribute, alpha 1: closed form of the ridge with a free intercept.
_RIDGE = f"""{_ITEMS},
cells AS (SELECT item_id, source, generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding)::DOUBLE AS y FROM items),
sums AS (SELECT source, pos, count(*) AS n, sum(y) AS s FROM cells GROUP BY source, pos),
base AS (SELECT pos, sum(s / (n + 1)) / sum(n / (n + 1)) AS b FROM sums GROUP BY pos),
weights AS (SELECT source, pos, b, (s - n * b) / (n + 1) AS w FROM sums JOIN base USING (pos)),
fitted AS (SELECT item_id, pos::INT AS pos, y, b + w AS fitted, y - b - w AS residual FROM cells JOIN weights USING (source, pos))"""
SQL["ridge_fitted"] = f"WITH {_RIDGE} SELECT item_id, pos, {_round('fitted')} AS fitted, {_round('residual')} AS residual FROM fitted"
SQL["ridge_coefficients"] = f"""WITH {_RIDGE}
SELECT 'source' AS attribute, (dense_rank() OVER (ORDER BY source) - 1)::INT AS idx, pos::INT AS pos, {_round('w')} AS value FROM weights"""
SQL["ridge_norms"] = f"""WITH {_RIDGE}
SELECT count(DISTINCT item_id) AS n, {_round('sqrt(sum(residual * residual))')} AS residual_norm, {_round('sqrt(sum(y * y))')} AS vector_norm,
       {_round('var_pop(residual) / var_pop(y)')} AS residual_variance_ratio FROM fitted"""

# -- metrics --------------------------------------------------------------------

_PREDICTIONS = f"""{_ITEMS},
coded AS (SELECT item_id, embedding, label, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS lang_idx,
                 (dense_rank() OVER (ORDER BY source) - 1)::INT AS source_idx FROM items),
logits AS (
  SELECT item_id, 'label' AS attribute, label AS truth, 10 AS num_classes, generate_subscripts(embedding[1:10], 1)::INT - 1 AS class, unnest(embedding[1:10]) AS x FROM coded
  UNION ALL SELECT item_id, 'lang', lang_idx, 4, generate_subscripts(embedding[11:14], 1)::INT - 1, unnest(embedding[11:14]) FROM coded
  UNION ALL SELECT item_id, 'source', source_idx, 20, generate_subscripts(embedding[15:34], 1)::INT - 1, unnest(embedding[15:34]) FROM coded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, attribute ORDER BY x DESC, class) AS rank FROM logits),
predictions AS (
  SELECT item_id, attribute, any_value(truth) AS truth, any_value(num_classes) AS num_classes, max(class) FILTER (rank = 1) AS predicted,
         bool_or(rank <= 5 AND class = truth) AS in_top_5 FROM ranked GROUP BY item_id, attribute),
classes AS (SELECT DISTINCT attribute, truth AS class FROM predictions UNION SELECT attribute, predicted FROM predictions),
scores AS (
  SELECT c.attribute, c.class, count(*) FILTER (truth = class AND predicted = class) AS tp,
         count(*) FILTER (truth <> class AND predicted = class) AS fp, count(*) FILTER (truth = class AND predicted <> class) AS fn,
         count(*) FILTER (truth = class) AS support
  FROM classes c JOIN predictions p USING (attribute) GROUP BY c.attribute, c.class),
rates AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec FROM scores),
f1s AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) AS f1 FROM rates),
report AS (
  SELECT attribute, acc AS accuracy, macro_f1, weighted_f1, CASE WHEN num_classes > 5 THEN top_5 ELSE acc END AS top_5_accuracy,
         num_classes, num_classes_in_data, num_samples
  FROM (SELECT attribute, avg((truth = predicted)::INT) AS acc, avg(in_top_5::INT) AS top_5, max(num_classes) AS num_classes, count(*) AS num_samples
        FROM predictions GROUP BY attribute)
  JOIN (SELECT attribute, avg(f1) FILTER (support > 0) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
               (count(*) FILTER (support > 0))::INT AS num_classes_in_data FROM f1s GROUP BY attribute) USING (attribute))"""
_AVERAGED = ["accuracy", "macro_f1", "weighted_f1", "top_5_accuracy"]
SQL["top_predictions"] = f"""WITH {_PREDICTIONS}
SELECT item_id, (rank - 1)::INT AS rank, class FROM ranked WHERE attribute = 'label' AND rank <= 5"""
SQL["confusion_counts"] = f"""WITH {_PREDICTIONS}
SELECT attribute, truth, predicted, count(*) AS n, count(*) FILTER (in_top_5) AS n_top_5 FROM predictions GROUP BY attribute, truth, predicted"""
SQL["class_scores"] = f"""WITH {_PREDICTIONS}
SELECT attribute, class, tp, fp, fn, support, {_round('prec')} AS precision, {_round('rec')} AS recall, {_round('f1')} AS f1 FROM f1s"""
_REPORT = ", ".join(f"{_round(c)} AS {c}" for c in _AVERAGED)
SQL["classification_report"] = f"WITH {_PREDICTIONS} SELECT attribute, {_REPORT}, num_classes, num_classes_in_data, num_samples FROM report"
SQL["metrics_round_trip"] = SQL["classification_report"]
SQL["average_report"] = f"WITH {_PREDICTIONS} SELECT " + ", ".join(f"{_round(f'avg({c})')} AS {c}" for c in _AVERAGED) + " FROM report"
_CE = """entropy AS (
  SELECT item_id, ln(list_sum(list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)))) - embedding[label + 1]::DOUBLE AS loss FROM items)"""
SQL["cross_entropy_rows"] = f"WITH {_ITEMS}, {_CE} SELECT item_id, {_round('loss')} AS loss FROM entropy"


def _cosine(low: int, high: int) -> str:
    a, b = f"o.embedding[{low}:{high}]::DOUBLE[]", f"n.embedding[{low}:{high}]::DOUBLE[]"
    return f"list_cosine_similarity({a}, {b})"


_COSINES = f"""{_SAMPLE},
cosines AS (SELECT s.item_id, s.pos, {_cosine(1, 32)} AS cos_a, {_cosine(33, 64)} AS cos_b
  FROM sample s JOIN items o ON o.item_id = s.item_id JOIN items n ON n.item_id = s.neg_id WHERE s.pos > 0),
pulls AS (SELECT item_id, ln(1 + sum(exp(cos_a / 0.1))) + ln(1 + sum(exp(cos_b / 0.1))) AS loss FROM cosines GROUP BY item_id)"""
SQL["cosine_rows"] = f"WITH RECURSIVE {_COSINES} SELECT item_id, pos, {_round('cos_a')} AS cos_a, {_round('cos_b')} AS cos_b FROM cosines"
SQL["contrastive_rows"] = f"WITH RECURSIVE {_COSINES} SELECT item_id, {_round('loss')} AS loss FROM pulls"
SQL["loss_means"] = f"""WITH RECURSIVE {_COSINES}, {_CE}
SELECT {_round('ce', 5)} AS cross_entropy, n AS n_rows, {_round('pull', 5)} AS contrastive, {_round('ce + 0.1 * pull', 5)} AS total
FROM (SELECT avg({_round('loss')}) AS ce, count(*) AS n FROM entropy), (SELECT avg({_round('loss')}) AS pull FROM pulls)"""

# -- lexicon, label vectors, encoder --------------------------------------------


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


_LEXICON = f"""
terms AS (SELECT DISTINCT item_id AS category, unnest({_tokens('text')}) AS term FROM benchmark),
words AS (SELECT doc_id, len(ts) AS n_tokens, unnest(ts) AS term FROM (SELECT doc_id, {_tokens('text')} AS ts FROM documents)),
counted AS (SELECT doc_id, any_value(n_tokens) AS n_tokens, term, count(*) AS n FROM words GROUP BY doc_id, term),
scores AS (SELECT doc_id, category, sum(n) / any_value(n_tokens) AS score FROM counted JOIN terms USING (term) GROUP BY doc_id, category)"""
SQL["lexicon_scores"] = f"WITH {_LEXICON} SELECT doc_id, category, {_round('score')} AS score FROM scores"
SQL["lexicon_summary"] = f"""WITH {_LEXICON},
filled AS (SELECT c.category, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT category FROM terms) c CROSS JOIN documents d
  LEFT JOIN scores s ON s.category = c.category AND s.doc_id = d.doc_id)
SELECT category, {_round('avg(score)')} AS mean, {_round('stddev_pop(score)')} AS std FROM filled GROUP BY category"""
SQL["count_empty_texts"] = f"""
SELECT count(*) AS n_items, count(*) FILTER (coalesce(trim(text, {_BLANKS}), '') = '') AS n_empty FROM conversations"""


def _hash_encoded(source: str, keys: str, text: str, width: int) -> str:
    """Signed md5 token buckets scaled to unit length, zeros included."""
    return f"""
  tokens AS (SELECT {keys}, md5(t) AS h FROM (SELECT {keys}, unnest(string_split({text}, ' ')) AS t FROM {source}) WHERE t <> ''),
  placed AS (SELECT {keys}, (('0x' || substr(h, 1, 8))::BIGINT % {width})::INT AS pos,
                    CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM tokens),
  buckets AS (SELECT {keys}, pos, sum(s)::DOUBLE AS v FROM placed GROUP BY {keys}, pos),
  norms AS (SELECT {keys}, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM buckets GROUP BY {keys}),
  dense AS (SELECT {keys}, unnest(range({width}))::INT AS pos FROM {source}),
  coded AS (SELECT {keys}, pos, coalesce(v / n, 0) AS v FROM dense LEFT JOIN buckets USING ({keys}, pos) LEFT JOIN norms USING ({keys}))"""


SQL["hash_vectors"] = f"""WITH cleaned AS (SELECT doc_id, {_STRIPPED} AS t0 FROM documents), {_hash_encoded('cleaned', 'doc_id', 't0', 64)}
SELECT doc_id, pos, {_round('v::FLOAT::DOUBLE', 4)} AS value FROM coded"""
SQL["encode_status"] = "SELECT 'ok' AS status, count(*) AS n FROM part"
_LABELS = f"""{_LABELLED}, named AS (SELECT doc_id AS item_id, {_NORMAL} AS region, coalesce(quality::VARCHAR, '') AS varietal FROM labelled),
names AS (SELECT region AS name FROM named UNION SELECT varietal FROM named)"""
SQL["label_vectors"] = f"""WITH {_LABELS}, {_hash_encoded('names', 'name', 'name', 16)}
SELECT item_id, pos, {_round('v::FLOAT::DOUBLE', 4)} AS value FROM named JOIN coded ON name = region
UNION ALL SELECT item_id, (pos + 16)::INT, {_round('v::FLOAT::DOUBLE', 4)} FROM named JOIN coded ON name = varietal"""
SQL["label_vector_zeros"] = f"""WITH {_LABELS}, {_hash_encoded('names', 'name', 'name', 16)},
zero AS (SELECT name FROM coded GROUP BY name HAVING max(abs(v)) <= 1e-8)
SELECT 'region' AS kind, count(*) AS n_items, count(name) AS n_zero FROM named LEFT JOIN zero ON name = region
UNION ALL SELECT 'varietal', count(*), count(name) FROM named LEFT JOIN zero ON name = varietal"""
SQL["label_baselines"] = f"""WITH {_LABELS}
SELECT encoder, item_id, width::BIGINT AS width, varietal <> '' AS has_plain FROM named, (VALUES ('narrow', 16), ('wide', 32)) AS e(encoder, width)"""

# -- augmentation ---------------------------------------------------------------

# Prompt wording and the named strategies.
_STRATEGIES = """(VALUES
  ('concise', 'extremely brief, factual, minimal words, no embellishments', 0.3::DOUBLE, 50),
  ('creative', 'imaginative, metaphorical, poetic, unexpected comparisons', 0.9::DOUBLE, 250)) AS s(strategy, instruction, temperature, max_tokens)"""
_REFUSALS = [m.lower().replace("'", "''") for m in REFUSAL_MARKERS]
SQL["build_prompts"] = f"""
SELECT doc_id AS base_id, strategy, v::INT AS variation, temperature, max_tokens, md5(
  'Create a new product description based on this original:' || chr(10) || chr(10) || '"' || text || '"' || chr(10) || chr(10) ||
  'Product attributes:' || chr(10) || '- language: ' || lang || chr(10) || '- origin: ' || source || chr(10) || chr(10) ||
  'Generate a variation that is: ' || instruction || chr(10) || chr(10) ||
  'Return ONLY the new description, with no additional commentary.') AS digest
FROM documents, {_STRATEGIES}, range(3) AS r(v)"""


def _usable(column: str) -> str:
    refused = " OR ".join(f"contains(lower({column}), '{m}')" for m in _REFUSALS)
    return f"coalesce(length(trim({column}, {_BLANKS})) >= 10 AND NOT ({refused}), false)"


SQL["check_responses"] = f"SELECT page_id, {_usable('html')} AS html_ok, {_usable('url')} AS url_ok FROM pages"
_VARIED = """varied AS (
  SELECT doc_id AS base_id, strategy, v::INT AS variation, 'Variation at ' || temperature || ': ' || text AS text
  FROM documents, (VALUES ('concise', '0.3'), ('descriptive', '0.7')) AS s(strategy, temperature), range(2) AS r(v))"""
_KEPT = f"WITH {_VARIED} SELECT base_id, strategy, variation, md5(text) AS digest, {{extra}} 1 AS attempts FROM varied WHERE {_usable('text')}"
SQL["augment_texts"] = _KEPT.format(extra="'ok' AS status,")
SQL["augmentation_round_trip"] = _KEPT.format(extra="")
SQL["augmentation_status"] = f"WITH {_VARIED} SELECT 'ok' AS status, count(*) AS n FROM varied WHERE {_usable('text')}"
SQL["augmentation_outcomes"] = f"""WITH {_VARIED},
moods AS (SELECT v.text, substr(md5(d.text), 1, 1) AS mood FROM varied v JOIN documents d ON d.doc_id = v.base_id),
tried AS (SELECT CASE WHEN mood IN ('0', '1') THEN 'retries_exhausted' WHEN mood = '4' THEN 'failed' WHEN mood = '5' OR NOT {_usable('text')} THEN 'unusable'
                      ELSE 'ok' END AS status, mood FROM moods)
SELECT status, count(*) AS n, sum(CASE WHEN status IN ('retries_exhausted', 'unusable') THEN 5 WHEN status = 'ok' AND mood IN ('2', '3') THEN 3 ELSE 1 END)::BIGINT AS attempts
FROM tried GROUP BY status"""

# -- network --------------------------------------------------------------------

# The untrained weights are functions of layer, row and column; row -1 is the bias.
# erf is summed from its power series, which has converged for the small sums here.
_ERF = ("(2 / sqrt(pi()) * list_sum(list_transform(range(0, 30), lambda k: "
        "pow(-1, k) * pow({x}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))))")


def _gelu(z: str) -> str:
    return f"0.5 * {z} * (1 + {_ERF.format(x=f'({z} / sqrt(2))')})"


def _weight(layer: str, inputs: str) -> str:
    return f"(2 * {_hash('42', layer, 'i', 'j')} / 1152921504606846976.0::DOUBLE - 1) / sqrt({inputs})"


_FORWARD = f"""
sizes AS (SELECT count(DISTINCT lang) AS n_lang, count(DISTINCT label) AS n_label FROM items),
cells AS (SELECT item_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM items
          UNION ALL SELECT item_id, -1, 1 FROM items),
w1 AS (SELECT i, j, {_weight("'projection'", '64')} AS w FROM range(-1, 64) AS a(i), range(32) AS b(j)),
z1 AS (SELECT item_id, j, sum(x * w) AS z FROM cells JOIN w1 USING (i) GROUP BY item_id, j),
h1 AS (SELECT item_id, j AS i, {_gelu('z')} AS x FROM z1 UNION ALL SELECT item_id, -1, 1 FROM items),
w2 AS (SELECT i, j, {_weight("'reduction'", '32')} AS w FROM range(-1, 32) AS a(i), range(8) AS b(j)),
z2 AS (SELECT item_id, j, sum(x * w) AS z FROM h1 JOIN w2 USING (i) GROUP BY item_id, j),
rep AS (SELECT item_id, j::INT AS pos, {_gelu('z')} AS r FROM z2),
blocks AS (SELECT item_id, CASE WHEN pos < 4 THEN 'lang' ELSE 'label' END AS attribute, pos % 4 AS i, r FROM rep
           UNION ALL SELECT item_id, unnest(['lang', 'label']), -1, 1 FROM items),
w3 AS (SELECT 'lang' AS attribute, i, j, {_weight("'classifier.lang'", '4')} AS w FROM range(-1, 4) AS a(i), range((SELECT n_lang FROM sizes)) AS b(j)
       UNION ALL SELECT 'label', i, j, {_weight("'classifier.label'", '4')} FROM range(-1, 4) AS a(i), range((SELECT n_label FROM sizes)) AS b(j)),
logits AS (SELECT item_id, attribute, j::INT AS class, sum(r * w) AS x FROM blocks JOIN w3 USING (attribute, i) GROUP BY item_id, attribute, j)"""
SQL["network_representations"] = f"WITH {_ITEMS}, {_FORWARD} SELECT item_id, pos, {_round('r')} AS value FROM rep"
SQL["streamed_representations"] = SQL["network_representations"]
SQL["network_logits"] = f"""WITH {_ITEMS}, {_FORWARD}
SELECT item_id, (class + CASE WHEN attribute = 'lang' THEN 0 ELSE n_lang END)::INT AS pos, {_round('x')} AS value FROM logits, sizes"""
_TRUTH = """truth AS (
  SELECT item_id, 'lang' AS attribute, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS truth FROM items
  UNION ALL SELECT item_id, 'label', (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::INT FROM items)"""
SQL["network_metrics"] = (
    f"WITH {_ITEMS}, {_FORWARD}, {_TRUTH}, class_counts AS (SELECT attribute, count(DISTINCT class)::INT AS num_classes FROM logits GROUP BY attribute), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, attribute ORDER BY x DESC, class) AS rank FROM logits "
    "JOIN truth USING (item_id, attribute) JOIN class_counts USING (attribute)),"
    + _PREDICTIONS[_PREDICTIONS.index("\npredictions AS"):]
    + f" SELECT attribute, {_REPORT}, num_classes, num_classes_in_data, num_samples FROM report")
SQL["network_losses"] = f"""WITH RECURSIVE {_SAMPLE}, {_FORWARD}, {_TRUTH},
entropy AS (SELECT l.item_id, l.attribute, ln(sum(exp(x))) - max(x) FILTER (class = truth) AS loss, arg_max(class, x) = any_value(truth) AS hit
            FROM logits l JOIN truth t ON t.item_id = l.item_id AND t.attribute = l.attribute GROUP BY l.item_id, l.attribute),
units AS (SELECT item_id, attribute, list(r ORDER BY i) AS v FROM blocks WHERE i >= 0 GROUP BY item_id, attribute),
cosines AS (SELECT s.item_id, o.attribute, list_cosine_similarity(o.v, n.v) AS c FROM sample s JOIN units o ON o.item_id = s.item_id
            JOIN units n ON n.item_id = s.neg_id AND n.attribute = o.attribute WHERE s.pos > 0),
pulls AS (SELECT item_id, attribute, ln(1 + sum(exp(c / 0.1))) AS loss FROM cosines GROUP BY item_id, attribute),
m AS (SELECT (SELECT sum(loss) FROM pulls) / (SELECT count(*) FROM items) AS pull,
             avg(loss) FILTER (attribute = 'lang') AS lang_loss, avg(hit::INT) FILTER (attribute = 'lang') AS lang_acc,
             avg(loss) FILTER (attribute = 'label') AS label_loss, avg(hit::INT) FILTER (attribute = 'label') AS label_acc FROM entropy)
SELECT {_round('pull')} AS contrastive, {_round('lang_loss')} AS lang_loss, {_round('lang_acc')} AS lang_acc, {_round('label_loss')} AS label_loss,
       {_round('label_acc')} AS label_acc, {_round('lang_loss + label_loss + 0.1 * pull')} AS total FROM m"""
_COLUMNS = {"projection": ("64", "32"), "reduction": ("32", "8"), "classifier.lang": ("4", "(SELECT n_lang FROM sizes)"), "classifier.label": ("4", "(SELECT n_label FROM sizes)")}
SQL["network_round_trip"] = f"WITH {_ITEMS}, sizes AS (SELECT count(DISTINCT lang) AS n_lang, count(DISTINCT label) AS n_label FROM items) " + " UNION ALL ".join(
    f"SELECT '{layer}' || CASE WHEN i < 0 THEN '.bias' ELSE '.weight' END AS layer, greatest(i, 0)::INT AS row, j::INT AS column, "
    f"{_round(_weight(repr(layer), rows), 9)} AS value FROM range(-1, {rows}) AS a(i), range({columns}) AS b(j)"
    for layer, (rows, columns) in _COLUMNS.items())
SQL["fit_and_transform"] = f"WITH {_ITEMS} SELECT item_id, 4::BIGINT AS lang_width, 4::BIGINT AS label_width, 5::BIGINT AS nuisance_width FROM items"
SQL["transform_new_items"] = "SELECT d.doc_id AS item_id, e.vec_id IS NOT NULL AS valid FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
SQL["export_files"] = f"""WITH {_ITEMS}
SELECT unnest(['full_embedding', 'lang_embedding', 'label_embedding', 'nuisance_embedding']) AS name, count(*) AS n_rows FROM items
UNION ALL SELECT 'lexicon_controls', count(*) FROM documents
UNION ALL SELECT 'classification_metrics', 2"""

# -- certificates ---------------------------------------------------------------
# What has no closed form is checked by what must hold for it: zero products, equal sums.

_KNOWN = "known AS (SELECT count(*) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"
SQL["projection_certificate"] = f"WITH {_KNOWN} SELECT pos::INT AS pos, n, 0.0::DOUBLE AS leak FROM known, (SELECT unnest(range(64)) AS pos)"
SQL["nuisance_certificate"] = f"""WITH {_KNOWN}
SELECT component::INT AS component, n, 0.0::DOUBLE AS leak, 0.0::DOUBLE AS overlap FROM known, (SELECT unnest(range(5)) AS component)"""
SQL["extend_certificate"] = f"""WITH {_KNOWN}
SELECT component::INT AS component, n, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS turn FROM known, (SELECT unnest(range(5)) AS component)"""
SQL["elbow_certificate"] = "SELECT dim::INT AS dim, 0.0::DOUBLE AS gap, true AS falls FROM (SELECT unnest(range(1, 21)) AS dim)"
SQL["ridge_certificate"] = " UNION ALL ".join(
    f"(WITH {_ITEMS} SELECT '{a}' AS attribute, (row_number() OVER (ORDER BY {a}::VARCHAR) - 1)::INT AS idx, count(*) AS n, 0.0::DOUBLE AS gap FROM items GROUP BY {a})"
    for a in ("lang", "source", "label"))
SQL["lexicon_certificate"] = """SELECT component::INT AS component, n, 0.0::DOUBLE AS overlap, 0.0::DOUBLE AS gap
FROM (SELECT count(*) AS n FROM documents), (SELECT unnest(range(10)) AS component)"""
SQL["training_certificate"] = f"""WITH {_KNOWN}
SELECT epoch::INT AS epoch, 0.004::DOUBLE AS learning_rate, true AS below, n - floor(n * 0.1)::BIGINT AS n_train, floor(n * 0.1)::BIGINT AS n_validation
FROM known, (SELECT unnest(range(3)) AS epoch)"""
SQL["tuning_certificate"] = """SELECT epochs::INT AS epochs, n_trials::BIGINT AS n_trials, true AS best_is_last FROM (VALUES (1, 4), (2, 1), (6, 1)) t(epochs, n_trials)"""
SQL["reload_certificate"] = """SELECT d.doc_id AS item_id, e.vec_id IS NOT NULL AS valid, 0.0::DOUBLE AS gap
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
