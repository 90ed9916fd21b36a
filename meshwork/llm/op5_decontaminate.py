"""Benchmark decontamination with a distributed positional inverted index. Plain DataFrame code.

Document frequencies of all benchmark words are counted over all documents. In each benchmark
text, every window of `window` words is assigned to its rarest word; those words are the anchors.
The index stores a posting for every occurrence of an anchor in the documents: row, position and
the words up to `window` - 1 places to either side; it is written to the shared folder. A lookup subtracts the anchor's place in the
benchmark text from its position (one alignment per posting), then intersects the neighbouring
words place by place, outwards from the rarest: a run of at least one window around the anchor is
an exact phrase. Proximity matches come from the same postings in the same pass: a window whose rarest
word stands in a document and of whose words at least `SHARE` do so within `SLOP` places of theirs
(on their side of the rarest word, among the stored neighbours). An exact phrase is one too.

Scale: documents are never shuffled, only postings of anchors and one count row per document.
Benchmark tables are broadcast only up to `BROADCAST_BYTES` (measured); beyond that they are
joined by word, with salted postings for frequent words. Texts of the benchmark that have equal
words are looked up once.

Defined results: null text has no words. A benchmark text without words matches nothing; one
shorter than a window is a window itself. Null item ids are not listed. Repeated documents are
judged row by row. Empty tables: no documents, no rows; no benchmark, nothing is hit. Extra
columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, key_columns, materialize, table, without

WINDOW = 10
SLOP, SHARE = 3, 0.8
BROADCAST_BYTES = 64 << 20
SALTS = 32
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
END = ""  # a posting of its own at the end of each document: carries the number of words


def words(text: Column) -> Column:
    """Words in order, letters as they are."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), "")


def lower(word: Column) -> Column:
    """A-Z lower-cased; words of ASCII only take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def item_classes(items: DataFrame, window: int) -> DataFrame:
    """Benchmark texts by equal words: cid, ws, w (window length), ids."""
    got = items.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words(F.col("text")), lower).alias("ws")).where(F.size("ws") > 0)
    return got.groupBy("ws").agg(F.collect_set("item_id").alias("ids")).select(F.xxhash64("ws").alias("cid"), "ws", F.least(F.size("ws"), F.lit(window)).alias("w"), "ids")


def _small(df: DataFrame, size: Column) -> bool:
    """Whether the rows, `size` bytes each, stay under the broadcast bound."""
    return (df.agg(F.sum(size)).head()[0] or 0) <= BROADCAST_BYTES


def _lookup(tokens: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Inner join on the word's hash: broadcast below the bound, else salted by place."""
    if small:
        return tokens.join(F.broadcast(terms), "h")
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tokens.withColumn("salt", F.pmod(F.hash("row", "pos"), F.lit(SALTS))).join(salted, ["h", "salt"]).drop("salt")


def _tokens(docs: DataFrame, end: bool, row: Column | None = None) -> DataFrame:
    """Every word of every document; `row` tells the documents apart (by default, each row is one)."""
    row = F.monotonically_increasing_id() if row is None else row
    ws = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("ws"))
    seen = F.concat("ws", F.array(F.lit(END))) if end else F.col("ws")
    return ws.select("row", "doc_id", "ws", F.posexplode(seen).alias("pos", "word")).withColumn("h", F.xxhash64(lower(F.col("word"))))


def anchors(docs: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """h and term, cid, q (its place in the text), w and the neighbouring words of the anchors."""
    at = classes.select("cid", "w", F.size("ws").alias("n"), F.posexplode("ws").alias("q", "term")).withColumn("h", F.xxhash64("term"))
    vocabulary = at.select("h").distinct()
    seen = _lookup(_tokens(docs, end=False).select("row", "pos", "h"), vocabulary, _small(vocabulary, F.lit(32))).groupBy("h").agg(F.count("*").alias("df"))
    ranked = at.join(seen, "h", "left").fillna(0, ["df"])
    start = ranked.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("w") + 1), F.least(F.col("q"), F.col("n") - F.col("w")))))
    rarest = start.groupBy("cid", "s").agg(F.min(F.struct("df", "term", "q")).alias("m")).select("cid", F.col("m.term").alias("term"), F.col("m.q").alias("q")).distinct()
    k = window - 1
    return rarest.join(classes, "cid").select(
        F.xxhash64("term").alias("h"), "term", "cid", "q", "w",
        F.reverse(F.slice("ws", F.greatest(F.lit(1), F.col("q") + 1 - k), F.least(F.lit(k), F.col("q")))).alias("il"),
        F.slice("ws", F.col("q") + 2, F.lit(k)).alias("ir"),
    )


def index(docs: DataFrame, found: DataFrame, window: int = WINDOW, row: Column | None = None, ends: bool = True) -> DataFrame:
    """The stored postings of the anchor words, and one of END per document: row, doc_id, pos, h and neighbours."""
    terms, k = found.select("h").distinct(), window - 1
    if ends:
        terms = terms.union(found.sparkSession.range(1).select(F.xxhash64(F.lit(END)))).distinct()
    return materialize(_lookup(_tokens(docs, ends, row), terms, _small(terms, F.lit(32))).select(
        "row", "doc_id", "pos", "h", "word",
        F.when(F.col("word") != END, F.slice("ws", F.greatest(F.lit(1), F.col("pos") + 1 - k), F.least(F.lit(k), F.col("pos")))).alias("dl"),
        F.when(F.col("word") != END, F.slice("ws", F.col("pos") + 2, F.lit(k))).alias("dr"),
    ))


def aligned(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Each posting with each place of its word in a benchmark text."""
    small = _small(found, F.lit(64) + F.octet_length(F.concat_ws(" ", "il", "ir")))
    return _lookup(postings.where(F.col("word") != END), found, small).where(lower(F.col("word")) == F.col("term"))


def _bound(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs == 0, F.greatest(F.size(a), F.size(b)).cast("bigint")).otherwise(differs - 1)


def _near(mine: Column, theirs: Column, slop: int) -> Column:
    """For each neighbour of the item, outwards, 1 if it stands within `slop` places of its own in the document, else 0."""

    def at(x: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), i + 1 - slop)
        return F.exists(F.slice(theirs, first, i + 2 + slop - first), lambda y: y == x).cast("int")

    return F.transform(mine, at)


def _proximate(v: Column, slop: int, share: float) -> Column:
    """Whether some window around the rarest word has enough of its words near their places. Places are
    only looked at where enough words stand anywhere among the neighbours."""
    w, need = v["w"], F.ceil(v["w"] * F.lit(share))
    held = lambda mine, theirs: F.size(F.filter(v[mine], lambda x: F.array_contains(v[theirs], x)))
    total = lambda flags, n: F.aggregate(F.slice(flags, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    flags = F.struct(_near(v["il"], v["dl"], slop).alias("l"), _near(v["ir"], v["dr"], slop).alias("r"))

    def some(f: Column) -> Column:  # n of the window's words stand left of the rarest
        fits = lambda n: (n <= F.size(f["l"])) & (w - 1 - n <= F.size(f["r"]))
        return F.exists(F.sequence(F.lit(0), w - 1), lambda n: fits(n) & (total(f["l"], n) + total(f["r"], w - 1 - n) + 1 >= need))

    return F.when(held("il", "dl") + held("ir", "dr") + 1 >= need, _bound(flags, some)).otherwise(F.lit(False))


def phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, row: Column | None = None, proximity: tuple[int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The item classes and their matches: row, doc_id, cid, [start, end) of exact word runs, near (a
    proximity match, if asked for by slop and share; with null start and end it is no exact one); a
    row with null cid per document gives its words."""
    classes = materialize(item_classes(items, window))
    found = materialize(anchors(docs, classes, window))
    postings = index(docs, found, window, row)
    sides = F.struct(F.transform(F.reverse("dl"), lower).alias("dl"), F.transform("dr", lower).alias("dr"), "il", "ir", "w")

    def match(v: Column) -> Column:
        near = _proximate(v, *proximity) if proximity else F.lit(False)
        return F.struct(_common(v["dl"], v["il"]).alias("l"), _common(v["dr"], v["ir"]).alias("r"), near.alias("near"))

    exact = lambda m: m["l"] + m["r"] + 1 >= F.col("w")
    runs = aligned(postings, found).select("row", "doc_id", "pos", "cid", "w", F.explode(F.filter(F.transform(F.array(sides), match), lambda m: exact(m) | m["near"])).alias("m"))
    place = lambda c: F.when(exact(F.col("m")), c.cast("int"))
    hits = runs.select("row", "doc_id", "cid", "pos", place(F.col("pos") - F.col("m.l")).alias("start"), place(F.col("pos") + F.col("m.r") + 1).alias("end"), F.col("m.near").alias("near"))
    ends = postings.where(F.col("word") == END).select("row", "doc_id", F.lit(None).cast("bigint").alias("cid"), "pos", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("near"))
    return hits.unionByName(ends), classes


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, item_ids (sorted array), near_ids (items with a proximity match, sorted), spans (word runs covered)."""
    found, classes = phrases(docs, items, window, proximity=(slop, share))
    exact = F.col("start").isNotNull()
    per = found.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("cid").isNull(), F.col("pos"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(exact, F.struct("start", "end")))).alias("runs"),
        F.collect_set(F.when(exact, F.col("cid"))).alias("cids"),
        F.collect_set(F.when(F.col("near"), F.col("cid"))).alias("near"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    n_hit = F.aggregate("runs", zero, lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], r["end"]).alias("upto")))
    per = materialize(per.select("row", "doc_id", "n_words", n_hit["n"].alias("n_hit"), "runs", "cids", "near"))
    cids = F.array_union("cids", "near")
    named = per.where(F.size(cids) > 0).select("row", "cids", "near", F.explode(cids).alias("cid")).join(classes.select("cid", "ids"), "cid")
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.array_contains(c, F.col("cid")), F.col("ids"))))))
    named = named.groupBy("row").agg(ids("cids").alias("item_ids"), ids("near").alias("near_ids"))
    none = F.array().cast("array<string>")
    return per.join(named, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("item_ids", "near_ids")})


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that no benchmark window occurs in, columns kept."""
    found, _ = phrases(docs, items, window, F.struct(*[c.alias(n) for c, n in zip(key_columns(), ("_i", "_h"), strict=True)]))
    return without(docs, found.where("start is not null").select("row._i", "row._h"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near"))


_K = WINDOW - 1
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, w, list_aggregate(ws[s:s + w - 1], 'string_agg', ' ') AS win
       FROM (SELECT item_id, ws, least(len(ws), {WINDOW}) AS w, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT w FROM iw),
dw AS (SELECT r, w, s, list_aggregate(ws[s:s + w - 1], 'string_agg', ' ') AS win
       FROM (SELECT r, ws, w, unnest(range(1, len(ws) - w + 2)) AS s FROM d, sizes WHERE len(ws) >= w)),
m AS (SELECT dw.r, dw.s, dw.w, iw.item_id FROM dw JOIN iw USING (win, w)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + w)) AS p FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r),
dt AS (SELECT r, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM d),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
c AS (SELECT DISTINCT ws, least(len(ws), {WINDOW}) AS w FROM i WHERE len(ws) > 0),
wq AS (SELECT ws, w, s, unnest(range(s, s + w)) AS q FROM (SELECT ws, w, unnest(range(1, len(ws) - w + 2)) AS s FROM c)),
rare AS (SELECT DISTINCT ws, w, struct_extract(min(struct_pack(n := coalesce(df, 0), t := ws[q], q := q)), 'q') AS q FROM wq LEFT JOIN df ON term = ws[q] GROUP BY ws, w, s),
al AS (SELECT dt.r, rare.ws AS iws, w, list_reverse(rare.ws[greatest(1, q - {_K}):q - 1]) AS il, rare.ws[q + 1:q + {_K}] AS ir,
              list_reverse(d.ws[greatest(1, pos - {_K}):pos - 1]) AS dl, d.ws[pos + 1:pos + {_K}] AS dr FROM rare JOIN dt ON dt.term = rare.ws[q] JOIN d ON d.r = dt.r),
fl AS (SELECT r, iws, w, list_transform(range(1, len(il) + 1), lambda x: CAST(list_contains(dl[greatest(1, x - {SLOP}):x + {SLOP}], il[x]) AS INT)) AS nl,
              list_transform(range(1, len(ir) + 1), lambda x: CAST(list_contains(dr[greatest(1, x - {SLOP}):x + {SLOP}], ir[x]) AS INT)) AS nr FROM al),
nc AS (SELECT DISTINCT r, iws FROM fl WHERE len(list_filter(range(0, w), lambda l: l <= len(nl) AND w - 1 - l <= len(nr)
         AND coalesce(list_sum(list_filter(nl, lambda v, j: j <= l)), 0) + coalesce(list_sum(list_filter(nr, lambda v, j: j <= w - 1 - l)), 0) + 1 >= ceil(w * {SHARE}))) > 0),
nn AS (SELECT r, count(DISTINCT item_id) AS n_near FROM nc JOIN i ON i.ws = nc.iws GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r) LEFT JOIN nn USING (r)"""
