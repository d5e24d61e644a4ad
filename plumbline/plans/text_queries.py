"""Queries over text: normalisation, filters, BM25, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numbers, text
from plumbline.functions.stem import stemmed
from plumbline.operators import bm25, vectors

from .bindings import ITEMS, PARTS, QUERIES as ASKED, VECTORS, bound, normalized, plain
from .catalog import catalog

QUERIES, ORACLE_SQL, query = catalog()

POSTINGS = f"""
WITH items AS ({plain(ITEMS)}), asked AS ({plain(ASKED)}),
words AS (SELECT item_id, unnest(string_split({normalized('description')}, ' ')) AS term FROM items),
counts AS (SELECT item_id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2),
kept AS (SELECT * FROM counts JOIN vocab USING (term)),
lengths AS (SELECT item_id, sum(tf) AS dl FROM kept GROUP BY item_id),
stats AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT sum(dl) FROM lengths) / (SELECT count(*) FROM items)::DOUBLE AS avgdl),
postings AS (SELECT item_id, term, tf, df, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.6e0 + 0.4e0 * dl / avgdl)) AS weight
             FROM kept JOIN lengths USING (item_id), stats),
qwords AS (SELECT query_id, unnest(string_split({normalized('query')}, ' ')) AS term FROM asked),
qcounts AS (SELECT query_id, term, count(*) AS qtf FROM qwords WHERE term <> '' GROUP BY ALL),
scored AS (SELECT query_id, item_id, round(sum(qtf * weight), 6) AS bm25 FROM postings JOIN qcounts USING (term) GROUP BY ALL)
"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.index(bound(spark, sf_dir, ITEMS), "item_id", text.normalize(F.col("description")))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(postings(spark, sf_dir), "item_id", bound(spark, sf_dir, ASKED), "query_id", text.normalize(F.col("query")))


@query(POSTINGS + "SELECT query_id, item_id, bm25, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, item_id) AS r FROM scored) WHERE r <= 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 50 items of each query by BM25."""
    return bm25.topk(bm25_scores(spark, sf_dir), "query_id", "item_id", "bm25", 50)


@query(POSTINGS + "SELECT term, df FROM vocab")
def bm25_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two items or more."""
    return bm25.vocabulary(bm25.term_counts(bound(spark, sf_dir, ITEMS), "item_id", text.normalize(F.col("description"))))


@query(f"""WITH items AS (SELECT item_id, {normalized('title')} AS t FROM ({plain(PARTS)})),
counts AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(string_split(t, ' ')) AS term FROM items) WHERE term <> '' GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2), kept AS (SELECT * FROM counts JOIN vocab USING (term)),
lengths AS (SELECT item_id, sum(tf) AS dl FROM kept GROUP BY item_id),
stats AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT sum(dl) FROM lengths) / (SELECT count(*) FROM items)::DOUBLE AS avgdl)
SELECT item_id, term, tf, df, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.7e0 + 0.3e0 * dl / avgdl)), 6) AS weight FROM kept JOIN lengths USING (item_id), stats""")
def bm25_title_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term weights of the title index (b = 0.3)."""
    found = bm25.index(bound(spark, sf_dir, PARTS), "item_id", text.normalize(F.col("title")), b=0.3)
    return found.withColumn("weight", F.round("weight", 6))


@query(POSTINGS + """, known AS (SELECT * FROM qcounts JOIN (SELECT term FROM vocab) USING (term)), n AS (SELECT query_id, count(*) AS n_terms FROM known GROUP BY query_id)
SELECT query_id, item_id, count(*) AS n_matched, any_value(n_terms) AS n_terms, round(count(*) / any_value(n_terms), 6) AS coverage FROM postings JOIN known USING (term) JOIN n USING (query_id) GROUP BY query_id, item_id""")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a query's known terms that an item has."""
    return bm25.coverage(postings(spark, sf_dir), "item_id", bound(spark, sf_dir, ASKED), "query_id", text.normalize(F.col("query")))


@query(f"SELECT page_id, {normalized('html')} AS clean, len(list_filter(string_split({normalized('html')}, ' '), lambda w: w <> '')) AS n_tokens FROM pages")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised web pages and their token counts."""
    clean = text.normalize(F.col("html"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", clean.alias("clean"), text.n_tokens(clean).cast("long").alias("n_tokens"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split({normalized('text')}, ' '), lambda w: w <> ''))), ' ') AS query_key FROM conversations")
def query_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-order-free identity of each turn, stems included (stemming leaves other languages alone)."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select("conv_id", "turn", text.query_key(stemmed(text.normalize(F.col("text")))).alias("query_key"))


@query(f"SELECT item_id, {normalized('concat_ws(chr(32), title, title, title, title, title, substr(params, 1, 600), substr(price::VARCHAR, 1, 400))')} AS weighted FROM ({plain(PARTS)})")
def weighted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item text with the title five times (its limits are the field weights' own)."""
    p = bound(spark, sf_dir, PARTS)
    return p.select("item_id", text.weighted(F.col("title"), F.col("params"), F.col("price")).alias("weighted"))


@query(f"SELECT item_id, CAST(replace(nullif(regexp_extract(params, '(?i)рейтинг[^0-9]{{0,40}}?(\\d+(?:[.,]\\d+)?)', 1), ''), ',', '.') AS DOUBLE) AS threshold FROM ({plain(PARTS)})")
def rating_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least rating that a filter asks for."""
    return bound(spark, sf_dir, PARTS).select("item_id", text.rating_threshold(F.col("params")).alias("threshold"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""SELECT item_id, array_to_string(list_filter(string_split({normalized("regexp_replace(params, '(?i)рейтинг\\s+пользователя\\s*\\d+(?:[.,]\\d+)?\\s*звезд[0-9a-zа-я]*(?:\\s+и\\s+выше)?', ' ', 'g')")}, ' '),
 lambda w: w <> '' AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS filters FROM ({plain(PARTS)})""")
def clean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter words of weight."""
    return bound(spark, sf_dir, PARTS).select("item_id", text.clean_filter(F.col("params")).alias("filters"))


@query(f"""WITH p AS ({plain(PARTS)}), cut AS (SELECT item_id, regexp_extract(params, '^Вид услуги (.*) Тип услуги (.*) Рейтинг пользователя (.*)$', ['a', 'b', 'c']) AS m FROM p)
SELECT item_id, 'Вид услуги' AS key, m.a AS value FROM cut UNION ALL SELECT item_id, 'Тип услуги', m.b FROM cut UNION ALL SELECT item_id, 'Рейтинг пользователя', m.c FROM cut""")
def filter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of filter strings without separators."""
    return bound(spark, sf_dir, PARTS).select("item_id", F.inline(text.filter_pairs(F.col("params"))))


@query(f"""WITH p AS (SELECT item_id, lower(params) AS s FROM ({plain(PARTS)})), places AS (SELECT *, strpos(s, 'вид услуги') AS a, strpos(s, 'тип услуги') AS b FROM p)
SELECT item_id, concat(substr(s, a, 130), ' | ', substr(s, b, 130)) AS compact FROM places""")
def compact_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkable parts of the parameters (each key occurs once here)."""
    return bound(spark, sf_dir, PARTS).select("item_id", text.compact_params(F.col("params")).alias("compact"))


@query("""WITH phrases AS (SELECT DISTINCT lower(concat('вид услуги ', p_type)) AS phrase FROM part), items AS (SELECT p_partkey AS item_id, lower(concat('Вид услуги ', p_type, ' Тип услуги ', p_brand)) AS params FROM part)
SELECT phrase, count(*) AS n_items FROM phrases JOIN items ON contains(params, phrase) GROUP BY phrase""")
def filter_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that hold each distinct filter phrase: the few phrases travel, each item is read once."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.concat(F.lit("Вид услуги "), F.col("p_type"), F.lit(" Тип услуги "), F.col("p_brand"))
    phrases = p.select(F.explode(text.checkable_filters(F.concat(F.lit("Вид услуги "), F.col("p_type")))).alias("phrase")).distinct()
    # one row of all phrases (as many as p_type has values); items unfold those that they hold
    listed = phrases.agg(F.collect_list("phrase").alias("phrases"))
    held = p.select(text.compact_params(raw).alias("params")).crossJoin(F.broadcast(listed))
    return held.select(F.explode(F.filter("phrases", lambda f: F.contains(F.col("params"), f))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n_items"))


@query(f"SELECT item_id, regexp_replace(concat(substr(title, 1, 150), '. ', substr(params, 1, 500), '. ', substr(price::VARCHAR, 1, 500)), '\\s+', ' ', 'g') AS item_text, concat_ws('. ', substr(title, 1, 200), substr(params, 1, 300)) AS query_text FROM ({plain(PARTS)})")
def embedder_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encoder reads, with its field limits."""
    p = bound(spark, sf_dir, PARTS)
    return p.select("item_id", text.embedder_item(F.col("title"), F.col("params"), F.col("price")).alias("item_text"), text.embedder_query(F.col("title"), F.col("params")).alias("query_text"))


_DENSE = f"""WITH v AS ({plain(VECTORS)}), q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM v WHERE vec_id % 50 = 0), i AS (SELECT vec_id AS item_id, embedding AS e, label AS il FROM v),
s AS (SELECT query_id, item_id, ql, il, round(list_dot_product(qe::DOUBLE[], e::DOUBLE[]), 6) AS cos FROM q, i)
"""
_TOP = "SELECT query_id, item_id, cos, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item_id) AS r FROM s {where}) WHERE r <= {k}"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth vector asks, all vectors are searched."""
    v = bound(spark, sf_dir, VECTORS)
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), v.select(F.col("vec_id").alias("item_id"), "embedding", "label")


@query(_DENSE + _TOP.format(where="", k=100))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest 100 items by cosine."""
    q, i = _sides(spark, sf_dir)
    return vectors.dense_topk(i, "item_id", "embedding", q, "query_id", "embedding", 100)


@query(_DENSE + _TOP.format(where="WHERE ql = il", k=30))
def dense_masked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest 30 items inside the query's zone."""
    q, i = _sides(spark, sf_dir)
    return vectors.dense_topk(i, "item_id", "embedding", q, "query_id", "embedding", 30, item_zone="label", query_zone="label")


@query()
def dense_fp16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest 100 items with vectors and scores rounded through half precision."""
    q, i = _sides(spark, sf_dir)
    return vectors.dense_topk(i, "item_id", "embedding", q, "query_id", "embedding", 100, fp16=True)


@query(_DENSE + """SELECT query_id, max(cos) AS best, coalesce(max(CASE WHEN ql = il THEN cos END), -1.0) AS best_zone, round(max(cos) - coalesce(max(CASE WHEN ql = il THEN cos END), -1.0), 6) AS gap FROM s GROUP BY query_id""")
def cosine_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cosine over all items and inside the zone (-1 if the zone is empty)."""
    q, i = _sides(spark, sf_dir)
    best = vectors.dense_topk(i, "item_id", "embedding", q, "query_id", "embedding", 1).select("query_id", F.col("cos").alias("best"))
    zone = vectors.dense_topk(i, "item_id", "embedding", q, "query_id", "embedding", 1, item_zone="label", query_zone="label").select("query_id", F.col("cos").alias("z"))
    joined = best.join(zone, "query_id", "left").withColumn("best_zone", F.coalesce("z", F.lit(-1.0)))
    return joined.select("query_id", "best", "best_zone", F.round(F.col("best") - F.col("best_zone"), 6).alias("gap"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:32], lambda v: v::DOUBLE * v::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:32], lambda v: v::DOUBLE * v::DOUBLE))), 6) AS first FROM embeddings""")
def second_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 dimensions, normalised again."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 32).alias("short"))
    norm = F.sqrt(F.aggregate("short", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.get(numbers.unit(F.col("short")), F.lit(0)), 6).alias("first"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 2 = 0 THEN 1 END AS source, CASE WHEN vec_id % 3 = 0 THEN round(embedding[1]::DOUBLE, 6) WHEN vec_id % 2 = 0 THEN round(-embedding[1]::DOUBLE, 6) END AS first, CASE WHEN vec_id % 3 = 0 OR vec_id % 2 = 0 THEN CAST(len(embedding) AS INT) END AS size FROM embeddings""")
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector of each id from the preferred source that has it."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    other = v.where("vec_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    found = vectors.lookup(v.select("vec_id"), "vec_id", [v.where("vec_id % 3 = 0"), other])
    return found.select("vec_id", "source", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("size"))


_QTEXT = f"""SELECT item_id, {normalized('title')} AS query_only, lower(split_part(params, ' ', 3)) || ' brand' AS filter_only, 'query: ' || title AS asked, 'passage: ' || params AS held FROM ({plain(PARTS)})"""


@query(f"WITH t AS ({_QTEXT}) SELECT item_id, query_only, filter_only, trim(query_only || ' ' || query_only || ' ' || filter_only) AS query_text, asked, held FROM t")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query alone, its filters alone, both together, and with an encoder's prefixes."""
    p = bound(spark, sf_dir, PARTS)
    q, f = F.col("title"), F.col("params")
    return p.select("item_id", text.query_only_text(q).alias("query_only"), text.filter_only_text(f).alias("filter_only"), text.query_text(q, f).alias("query_text"), text.prefixed(q, "asymmetric", True).alias("asked"), text.prefixed(f, "asymmetric", False).alias("held"))


#: Words and their stems by the published algorithm.
STEMS = {"важная": "важн", "вести": "вест", "вещество": "веществ", "кошками": "кошк", "падение": "паден", "павильон": "павильон", "павлиний": "павлин", "падшую": "падш", "покойный": "покойн", "прекрасные": "прекрасн", "слышал": "слыша", "ремонта": "ремонт", "телевизоров": "телевизор", "услуги": "услуг", "красивейший": "красив", "бегающий": "бега", "возможность": "возможн", "умывшись": "ум"}


@query("SELECT p_partkey, concat(" + ", ' ', ".join(f"CASE WHEN (p_partkey + {i}) % 3 = 0 THEN '{s}' ELSE 'lamp' END" for i, s in enumerate(STEMS.values())) + ") AS stems FROM part")
def russian_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of Russian words within other text."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = [F.when((F.col("p_partkey") + i) % 3 == 0, w).otherwise("lamp") for i, w in enumerate(STEMS)]
    return p.select("p_partkey", stemmed(F.concat_ws(" ", *words)).alias("stems"))
