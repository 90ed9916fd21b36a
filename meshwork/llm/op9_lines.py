"""Line deduplication by a segment-partition edit join. Plain DataFrame code.

A line goes if the same line, or one within `threshold` edits, stands earlier in the corpus
(order: doc_id, then place). Equal lines are grouped first. Different lines of at least
`min_chars` code points are then joined by edit distance: each is cut into `threshold` + 1
segments, indexed under (length, segment number, segment); a longer or equal line probes the
substrings, length-aware, at the places where such a segment can stand if the edits before and
after it are within the threshold. A segment that more than `CROWDED` lines are indexed under (a
template with numbers) is not joined as such at threshold 1: its lines also agree in all of the rest
but one small piece, so they are keyed by what stands before and after each of at most `PIECES`
pieces of the rest, and their number of rows grows with the lines, not with their square.
Candidates must agree in counts of some letters (each edit
moves those by at most two) before the texts are fetched and verified by a banded bit-parallel edit
distance (`within`): the differences down a column of the table, in the band of 2 * `threshold` + 1
rows around the diagonal, are bits of two numbers, renewed with a few operations per code point.

Scale: what is shuffled for the join is a fixed number of rows of a few numbers per distinct
line, never the lines' texts; texts are fetched by hash for candidates only (the wanted hashes are
broadcast up to `BROADCAST_BYTES`, measured; beyond that the lines are shuffled by hash). Equal
lines are counted on the map side first, so one line that fills a third of the corpus is one row
per task. The texts of the documents move only if the table of decisions is too large to broadcast
(measured).

Defined results: a null text has one empty line, like an empty text. Empty lines and lines of
white space only are never dropped or linked. Rows that repeat a doc_id and text are one document
and get the same decisions; null ids count as -1; of different texts with one id, lines at the same
place are both first. A line nearer to none than the threshold stays.
Empty tables give no rows; extra columns are kept by `dedup`, ignored by `query`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, key_columns, materialize, table, wrapped

THRESHOLD, MIN_CHARS = 1, 20
BROADCAST_BYTES = 32 << 20
CROWDED, PIECES = 200, 128
FULL = r"[^ \t\r]"
LETTERS = "etaoin"  # counted to rule candidates out; any letters would do


def line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line, F.lit(9)).alias("b"))


def lines(docs: DataFrame) -> DataFrame:
    """Every line that counts: _i, _h (its document), no (its place from 0), line."""
    i, h = key_columns()
    split = docs.select(i.alias("_i"), h.alias("_h"), F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("all"))  # the text's hash once, not for each line
    at = split.select("_i", "_h", F.posexplode("all").alias("no", "line"))
    return at.where(F.col("line").rlike(FULL))


def place() -> Column:
    """Where a line stands in the corpus, as one number that hash aggregation can update in place."""
    return F.col("_i").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("no").cast("decimal(10,0)")


def _document(p: Column) -> Column:
    """The document id of a place."""
    size = F.lit(1 << 31).cast("decimal(10,0)")
    return ((p - F.pmod(p, size)) / size).cast("long")


def distinct_lines(at: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """One row per different line: k (hash), first (place where it stands first), times, n, c (letters), own and asked (keys it is indexed and probes under)."""
    at = at.withColumn("n", F.length("line"))  # once: each count of code points reads the line
    own, asked = keys(F.col("line"), F.col("n"), threshold, min_chars)
    named = {f"own{j}": c for j, c in enumerate(own)} | {f"asked{j}": c for j, c in enumerate(asked)}
    rows = at.select(line_hash(F.col("line")).alias("k"), place().alias("p"), "n", _letter_counts(F.col("line")).alias("c"), *[c.alias(x) for x, c in named.items()])
    got = rows.groupBy("k").agg(F.min("p").alias("first"), F.count("*").alias("times"), *[F.first(x).alias(x) for x in ("n", "c", *named)])
    return got.select("k", "first", "times", "n", "c", F.array(*[x for x in named if x[0] == "o"]).alias("own"), F.array_distinct(F.array(*[x for x in named if x[0] == "a"])).alias("asked"))


def _letter_counts(line: Column) -> Column:
    """Counts of LETTERS modulo 1,024 in one number, ten bits each."""
    total = F.lit(0).cast("bigint")
    for j, c in enumerate(LETTERS):
        total = total + F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("bigint").bitwiseAND(F.lit(1023)), 10 * j)
    return total


def _letters_agree(a: str, b: str, threshold: int) -> Column:
    """Each edit changes the counts by two in sum at most."""
    total = F.lit(0).cast("bigint")
    for j in range(len(LETTERS)):
        d = F.abs(F.shiftright(F.col(a), 10 * j).bitwiseAND(F.lit(1023)) - F.shiftright(F.col(b), 10 * j).bitwiseAND(F.lit(1023)))
        total = total + F.least(d, F.lit(1024) - d)
    return total <= 2 * threshold


def _segments(n: Column, threshold: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of the segments of a line of n code points: even, longer ones last."""
    parts = threshold + 1
    short, extra = F.floor(n / parts).cast("int"), n % parts
    return [(F.lit(i) * short + F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - extra)), short + (F.lit(i) >= F.lit(parts) - extra).cast("int")) for i in range(parts)]


def _key(line: Column, n: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(n, F.lit(i), F.substring(line, start + 1, size))


def keys(line: Column, n: Column, threshold: int, min_chars: int) -> tuple[list[Column], list[Column]]:
    """What a line is indexed under, and what it probes for partners that are as long or shorter."""
    own = [F.when(n >= min_chars, _key(line, n, i, s, z)) for i, (s, z) in enumerate(_segments(n, threshold))]
    probes = []
    for less in range(threshold + 1):  # partners are `less` code points shorter
        m = n - less
        for i, (s, z) in enumerate(_segments(m, threshold)):
            before, after = i, threshold - i
            for shift in range(max(-before, less - after), min(before, less + after) + 1):
                fits = (s + shift >= 0) & (s + shift + z <= n) & (m >= min_chars)
                probes.append(F.when(fits, _key(line, m, i, s + shift, z)))
    return own, probes


def _texts(at: DataFrame, wanted: DataFrame, many: int) -> DataFrame:
    """k and line of the lines whose hashes are wanted: `many` at most."""
    small = many * 32 <= BROADCAST_BYTES
    got = at.select(line_hash(F.col("line")).alias("k"), "line").join(F.broadcast(wanted) if small else wanted, "k")
    return materialize(got.groupBy("k").agg(F.first("line").alias("line")))


def _rests(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """For lines with crowded segments (threshold 1): k, n, asks, and s, keys of what stands around each
    piece of the rest beside the segment. A line asks as a partner of lines as long (`less` 0) or one
    shorter (1); the rest of the longer line is cut where the shorter one's is."""
    n, rows = F.col("n"), []
    for less in (0, 1):
        m = n - less
        for i, (start, size) in enumerate(_segments(m, 1)):
            for asks in (False, True):
                if not asks:
                    start_, size_ = _segments(n, 1)[i]
                    key = _key(F.col("line"), n, i, start_, size_)
                    rest = F.substring("line", start_ + size_ + 1, n) if i == 0 else F.substring("line", F.lit(1), start_)
                    r = F.length(rest)
                else:
                    key = _key(F.col("line"), m, i, start + (0 if i == 0 else less), size)
                    rest = F.substring("line", start + size + 1, n) if i == 0 else F.substring("line", F.lit(1), start + less)
                    r = F.length(rest) - less
                rows.append(F.struct(key.alias("s"), rest.alias("rest"), r.alias("r"), F.lit(less).alias("less"), F.lit(asks).alias("asks")))
    each = lines.withColumn("n", F.length("line")).select("k", "n", F.explode(F.array(*rows)).alias("e")).select("k", "n", "e.*")
    each = each.join(hot, "s").withColumn("w", F.ceil(F.col("r") / F.lit(PIECES)).cast("int"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("r") / F.col("w")).cast("int") - 1)).alias("piece"))
    begin = F.col("piece") * F.col("w")
    end = F.least(begin + F.col("w"), F.col("r")) + F.when(F.col("asks"), F.col("less")).otherwise(0)
    around = F.xxhash64("s", "less", "piece", F.substring("rest", F.lit(1), begin), F.substring("rest", end + 1, F.length("rest")))
    return each.select("k", "n", "asks", around.alias("s"))


def within(x: Column, y: Column, threshold: int) -> Column:
    """Whether two lines are within `threshold` (30 at most) edits; y must be as long or up to `threshold` code points longer.

    Bit b of a column j stands for row j - threshold + b; beyond the band each step costs one, so
    values in it are never too small, and exact where the distance is within the threshold."""
    k, full = threshold, (1 << 2 * threshold + 1) - 1
    equal = lambda xs, c, j: sum((F.when(F.get(xs, j - k + b) == c, F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint") for b in range(2 * k + 1)), F.lit(0).cast("bigint"))
    start = F.struct(F.lit(full >> k + 1 << k + 1).cast("bigint").alias("up"), F.lit((1 << k + 1) - 1).cast("bigint").alias("down"), F.lit(0).cast("bigint").alias("cost"))

    def column(state: Column, m: Column) -> Column:
        up, down = F.shiftright(state["up"], 1).bitwiseOR(F.lit(1 << 2 * k)), F.shiftright(state["down"], 1)
        free = (m.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(m).bitwiseOR(down).bitwiseAND(F.lit(full))  # the diagonal step costs nothing
        right_up = F.shiftleft(down.bitwiseOR(F.bitwise_not(free.bitwiseOR(up))), 1).bitwiseOR(F.lit(1))
        right_down = F.shiftleft(free.bitwiseAND(up), 1)
        new_up = right_down.bitwiseOR(F.bitwise_not(free.bitwiseOR(right_up))).bitwiseAND(F.lit(full))
        return F.struct(new_up.alias("up"), free.bitwiseAND(right_up).alias("down"), (state["cost"] + 1 - F.shiftright(free, k).bitwiseAND(F.lit(1))).alias("cost"))

    def corner(state: Column) -> Column:
        """From the diagonal up to the last row of x."""
        longer, cost = F.length(y) - F.length(x), state["cost"]
        for r in range(k):
            step = F.shiftright(state["up"], k - r).bitwiseAND(F.lit(1)) - F.shiftright(state["down"], k - r).bitwiseAND(F.lit(1))
            cost = cost - F.when(longer > r, step).otherwise(F.lit(0))
        return cost <= k

    masks = F.flatten(F.transform(F.array(F.split(x, "")), lambda xs: F.transform(F.split(y, ""), lambda c, j: equal(xs, c, j))))  # the outer one names x's code points, which are split once
    return F.aggregate(masks, start, column, corner)


def edit_pairs(at: DataFrame, different: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(x, y): hashes of different lines within `threshold` edits, each pair once."""
    a = different.select(F.explode("asked").alias("s"), F.col("k").alias("y"), F.col("n").alias("yn"), F.col("c").alias("yc")).where("s is not null")
    b = different.select(F.explode("own").alias("s"), F.col("k").alias("x"), F.col("n").alias("xn"), F.col("c").alias("xc")).where("s is not null")
    near = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("x") < F.col("y")))
    found = lambda a, b: a.join(b, (a["s"] == b["s"]) & near & (F.col("yn") - F.col("xn") <= threshold) & _letters_agree("xc", "yc", threshold)).select("x", "y")
    likely = None
    if threshold == 1:
        hot = materialize(b.groupBy("s").agg(F.count("*").alias("m")).where(F.col("m") > CROWDED).select("s"))
        if n_hot := hot.count():
            hot = F.broadcast(hot) if n_hot * 16 <= BROADCAST_BYTES else hot
            crowd = materialize(a.select("s", F.col("y").alias("k")).union(b.select("s", F.col("x").alias("k"))).join(hot, "s").select("k").distinct())
            rests = _rests(_texts(at, crowd, crowd.count()), hot).join(different.select("k", "c"), "k")
            rests = materialize(rests)
            one, other = rests.where("asks"), rests.where("not asks")
            likely = found(one.select("s", F.col("k").alias("y"), F.col("n").alias("yn"), F.col("c").alias("yc")), other.select("s", F.col("k").alias("x"), F.col("n").alias("xn"), F.col("c").alias("xc")))
            a, b = a.join(hot, "s", "left_anti"), b.join(hot, "s", "left_anti")
    likely = materialize((found(a, b) if likely is None else found(a, b).union(likely)).distinct())
    texts = _texts(at, likely.select(F.col("x").alias("k")).union(likely.select("y")).distinct(), 2 * likely.count())
    pairs = likely.join(texts.select(F.col("k").alias("x"), F.col("line").alias("xl")), "x").join(texts.select(F.col("k").alias("y"), F.col("line").alias("yl")), "y")
    return pairs.where(within(F.col("xl"), F.col("yl"), threshold)).select("x", "y")


def decisions(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines with a decision to make: _i, _h, no, gone (it goes), links (different lines within the threshold), kept_in (id of the document that keeps its like)."""
    at = lines(docs)
    different = materialize(distinct_lines(at, threshold, min_chars))
    pairs = materialize(edit_pairs(at, different, threshold))
    both = pairs.select(F.col("x").alias("k"), F.col("y").alias("o")).union(pairs.select(F.col("y"), F.col("x")))
    known = different.select("k", "first")
    linked = both.join(known.withColumnRenamed("k", "o").withColumnRenamed("first", "other"), "o").groupBy("k").agg(F.min("other").alias("other"), F.count("*").alias("links"))
    facts = known.join(different.where("times > 1").select("k", "times"), "k", "left").join(linked, "k", "left").where("times is not null or links is not null")
    facts = facts.select("k", "first", F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).alias("links"), _document(F.least("first", "other")).alias("kept_in"))
    return at.select("_i", "_h", "no", line_hash(F.col("line")).alias("k")).join(facts, "k").select("_i", "_h", "no", (F.col("near") | (F.col("first") != place())).alias("gone"), "links", "kept_in")


def marked(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc (all columns of `docs`), gone (places of the lines that go; null or empty for none), links, kept_in (documents that keep their like), text without them."""
    per = decisions(docs, threshold, min_chars).distinct().groupBy("_i", "_h").agg(F.collect_list(F.when(F.col("gone"), F.col("no"))).alias("gone"), F.sum("links").alias("links"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("kept_in")))).alias("kept_in"))
    per = bounded(per, F.size("gone") * 4 + F.size("kept_in") * 8 + 64)
    parts = F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    joined = wrapped(docs).join(per, ["_i", "_h"], "left").withColumn("any", F.coalesce(F.size("gone"), F.lit(0)) > 0)
    return joined.select("doc", "gone", "links", "kept_in", "any", F.when(F.col("any"), kept).otherwise(F.col("doc.text")).alias("kept"))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs`, columns kept, without repeated lines; documents of which no line is left go, n_chars follows the text."""
    got = marked(docs, threshold, min_chars).where(~F.col("any") | F.col("kept").rlike(r"[^ \t\r\n]"))
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("any"), F.length("kept").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return got.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n")).cast("long")
    return marked(docs).select("doc.doc_id", n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce(F.array_join("kept_in", ","), F.lit("")).alias("kept_in"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT DISTINCT coalesce(doc_id, -1) AS i, coalesce(text, '') AS text FROM documents),
p AS (SELECT i, text, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT i, text, unnest(range(0, len(ls))) AS no, unnest(ls) AS line FROM p),
c AS (SELECT * FROM l WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''),
u AS (SELECT line, min((i, no)) AS first, count(*) AS n FROM c GROUP BY line),
w AS (SELECT line, first, length(line) AS n FROM u WHERE length(line) >= {MIN_CHARS}),
e AS (SELECT a.line AS a, b.line AS b, a.first AS af, b.first AS bf FROM w a JOIN w b ON b.n BETWEEN a.n AND a.n + {THRESHOLD} AND a.line <> b.line AND (a.n < b.n OR a.line < b.line)
      WHERE (substr(a.line, 1, a.n // 3) = substr(b.line, 1, a.n // 3) OR right(a.line, a.n // 3) = right(b.line, a.n // 3) OR a.n < 200) AND levenshtein(a.line, b.line) <= {THRESHOLD}),
s AS (SELECT a AS line, af AS first, bf AS other FROM e UNION ALL SELECT b, bf, af FROM e),
f AS (SELECT line, count(*) AS links, min(other) AS other, min(other) < min(first) AS near FROM s GROUP BY line),
g AS (SELECT c.i, c.text, c.no, coalesce(f.near, false) OR u.first <> (c.i, c.no) AS gone, coalesce(f.links, 0) AS links, CASE WHEN f.near THEN struct_extract(f.other, 1) ELSE struct_extract(u.first, 1) END AS kept_in FROM c JOIN u USING (line) LEFT JOIN f USING (line)),
k AS (SELECT i, text, list(no) FILTER (WHERE gone) AS gone, sum(links) AS links, list_sort(list(DISTINCT kept_in) FILTER (WHERE gone)) AS kept_in FROM g GROUP BY i, text)
SELECT doc_id, CAST(len(string_split(coalesce(o.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(len(k.gone), 0) AS BIGINT) AS n_gone, CAST(coalesce(links, 0) AS BIGINT) AS n_links, coalesce(array_to_string(k.kept_in, ','), '') AS kept_in,
       sha256(array_to_string(list_filter(string_split(coalesce(o.text, ''), chr(10)), lambda x, j: NOT coalesce(list_contains(k.gone, j - 1), false)), chr(10))) AS kept_sha256
FROM documents o LEFT JOIN k ON k.i = coalesce(o.doc_id, -1) AND k.text = coalesce(o.text, '')"""
