"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations alone.

A line is compared by its lower-cased words; the edit bound is one word inserted, deleted or replaced.
Lines of fewer than `min_words` (5) words are left alone, or with `short_lines` have an edit bound of 0:
they go for equal words only, lines of one word (all of a script without blanks) included.  Lines
without a word stay.  A line goes if the same words, or a line
within the bound, come earlier in the corpus, in order of (doc_id, hash of the text, line number).

Two lines are within the bound exactly if they share a variant: the words before a place and the words
behind it, where the place is either one word of the line (deleted) or a gap between words.  A
variant's key is made of the sums of word hashes taken with their places, from the front before it and
from the back behind it; so all variants of a line cost its length.  All lines of one key are within
the bound of each other, so each meets the key's earliest line only, and no pairs are formed.  That
link is then verified on the words.

Variants are made only for lines that share a half with another line, and only in the other half: one
edit leaves the first or the second half of the shorter line whole, so a line without such a partner
has no match, and one that shares its first half can differ behind it only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.llm.common import drop_written, free_shuffles, read, spare, written

MIN_WORDS = 5
#: Bits of the maps that say which rows may have a partner; they bound a broadcast (2**20 rows of 64 bits), not the result.
MAP_BITS = 1 << 26
#: Bits of a word's hash that enter a sum; sums of 2**20 words stay within 62 bits.
MASK = (1 << 42) - 1
LINE = ["h1", "h2"]


def _words(line: Column) -> Column:
    blank = F.when(line.rlike("[\\t\\r\\x0B\\f]"), F.regexp_replace(line, "[\\t\\r\\x0B\\f]", " ")).otherwise(line)
    return F.array_remove(F.split(F.lower(blank), " "), "")


def _slice_hash(words: Column, kind: int, size: Column, first: Column, n: Column) -> Column:
    return F.xxhash64(F.lit(kind), size, F.array_join(F.slice(words, first, n), " "))


def _half_keys(words: Column, w: Column) -> Column:
    """Halves of the line, and of the line as the longer of two: what one edit must leave whole."""
    p, q = F.floor(w / 2).cast("int"), F.floor((w - 1) / 2).cast("int")
    return F.array(
        _slice_hash(words, 0, w, F.lit(1), p),
        _slice_hash(words, 1, w, p + 1, w - p),
        _slice_hash(words, 0, w - 1, F.lit(1), q),
        _slice_hash(words, 1, w - 1, q + 2, w - 1 - q),
    )


def split_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, th (hash of the text), line_no and words of every line."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "th", "line_no", _words(F.col("line")).alias("words"))


#: Items that are added up at a time: each step copies what it has so far, so that long lines take one run a block.
BLOCK = 128


def _running(values: Column, start: Column) -> Column:
    """Running sums of a short array, the start first."""
    return F.aggregate(values, F.array(start), lambda acc, h: F.concat(acc, F.array(F.element_at(acc, -1) + h)))


def _with_sums(df: DataFrame, name: str, hashes: Column) -> DataFrame:
    """df with the running sums of an array, 0 first: of each block, and then of the blocks' totals.

    Each step is a column of its own, so that it is worked out once a row.
    """
    zero = F.lit(0).cast("bigint")
    h, blocks, totals = f"{name}_h", f"{name}_blocks", f"{name}_totals"
    last = F.floor((F.size(h) - 1) / BLOCK).cast("int")
    df = df.withColumn(h, hashes)
    df = df.withColumn(blocks, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: _running(F.slice(h, b * BLOCK + 1, BLOCK), zero)))
    df = df.withColumn(totals, _running(F.transform(blocks, lambda x: F.element_at(x, -1)), zero))
    inner = F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(x, 2, BLOCK), lambda v: v + F.get(totals, i))))
    return df.withColumn(name, F.concat(F.array(zero), inner))


#: What a shared half asks of a line: bits 0, 1 (first, second half shared with a line of its length),
#: 2, 3 (with a longer line), 4, 5 (as the longer one, with a shorter line).
def _asked(bits: Column) -> list[Column]:
    return [bits.bitwiseAND(F.lit(1 << k)) != 0 for k in range(6)]


def _span(want: Column, first: Column, last: Column) -> Column:
    """first .. last, nothing unless wanted."""
    none = F.slice(F.sequence(F.lit(0), F.lit(0)), 1, 0)
    return F.when(want & (first <= last), F.sequence(first, F.greatest(first, last))).otherwise(none)


def _variants(lines: DataFrame) -> DataFrame:
    """key of each variant that a line (words, w, bits) may share: words deleted, and gaps, in the half that is not shared."""
    front = F.transform("words", lambda x, i: F.xxhash64(x, i).bitwiseAND(F.lit(MASK)))
    back = F.transform(F.reverse("words"), lambda x, i: F.xxhash64(x, i, F.lit(1)).bitwiseAND(F.lit(MASK)))
    made = _with_sums(_with_sums(lines, "_f", front), "_b", back)
    key = lambda i, rest: F.xxhash64(i, rest, F.element_at("_f", i + 1), F.element_at("_b", rest + 1))  # noqa: E731
    w, zero = F.col("w"), F.lit(0)
    p, q = F.floor(w / 2).cast("int"), F.floor((w - 1) / 2).cast("int")
    same_1, same_2, short_1, short_2, long_1, long_2 = _asked(F.col("bits"))
    deleted = F.array_union(F.array_union(_span(same_1, p, w - 1), _span(same_2, zero, p - 1)), F.array_union(_span(long_1, q, w - 1), _span(long_2, zero, q)))
    gaps = F.array_union(_span(short_1, p, w), _span(short_2, zero, p))
    keys = F.concat(F.transform(deleted, lambda i: key(i, w - 1 - i)), F.transform(gaps, lambda i: key(i, w - i)))
    return made.select(*LINE, "first", F.explode(keys).alias("key"))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two word lists differ by one edit at most."""

    def same(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda s, t: s.eqNullSafe(t)), False)
        return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (same(a, b) + same(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def _maybe(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among those of wanted, by a bit map of hashes: the join that follows need not move the others."""
    spot = F.pmod(F.xxhash64(*keys, F.lit("map")), F.lit(MAP_BITS))
    bit = F.expr("shiftleft(1L, cast(_spot % 64 as int))")
    words = wanted.select(spot.alias("_spot")).groupBy(F.expr("_spot div 64").alias("_part")).agg(F.bit_or(bit).alias("_word"))
    marked = rows.withColumn("_spot", spot).withColumn("_part", F.expr("_spot div 64")).join(F.broadcast(words), "_part")
    return marked.where(F.col("_word").bitwiseAND(bit) != 0).select(*rows.columns)


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, short_lines: bool = False) -> DataFrame:
    """doc_id, th and removed (line numbers from 0) of the documents that lose lines.

    Rows without an id or text take no part.  Repeated rows (same id and text) count as one.
    """
    spark = docs.sparkSession
    # Lines without words are let go once the table is written: a filter before would split every line twice.
    every = split_lines(docs, doc_id, text).withColumn("w", F.size("words"))
    joined = F.array_join("words", " ")
    # A line without halves has no partner within an edit.
    halves = F.when(F.col("w") >= min_words, _half_keys(F.col("words"), F.col("w"))).otherwise(F.array().cast("array<bigint>"))
    keyed = every.select("doc_id", "th", "line_no", F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit("line"), joined).alias("h2"), "w", halves.alias("halves"))
    seen = written(keyed, "lines").where(F.col("w") >= (1 if short_lines else min_words))
    distinct = written(seen.groupBy(*LINE, "halves").agg(F.min(F.struct("doc_id", "th", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")), "lines-distinct")
    free_shuffles(spark)
    halves = distinct.select(F.posexplode("halves").alias("k", "half"), *LINE)
    own = F.when(F.col("k") < 2, F.col("h1"))
    shared = halves.groupBy("half").agg(F.min(own).alias("_a"), F.max(own).alias("_b"), F.max("k").alias("_k")).where("_a is not null and (_a <> _b or _k > 1)")
    shared = written(shared, "lines-shared")  # written before the join, so that Spark can split its hot keys
    free_shuffles(spark)
    bit = F.col("k").cast("int")
    same = F.when((bit < 2) & (F.col("_a") != F.col("_b")), F.pow(F.lit(2), bit).cast("int")).otherwise(0)
    cross = F.when(F.col("_k") > 1, F.pow(F.lit(2), bit + 2).cast("int")).otherwise(0)
    asked = _maybe(halves, shared, ["half"]).join(shared, "half").select(*LINE, same.bitwiseOR(cross).alias("bits")).where("bits <> 0")
    partnered = written(asked.groupBy(*LINE).agg(F.bit_or("bits").alias("bits")), "lines-asked")
    chosen = written(_maybe(distinct, partnered, LINE).join(partnered, LINE).select(*LINE, "first", "bits"), "lines-partnered")
    free_shuffles(spark)

    # The words of those lines, from the document of their first occurrence.
    wanted = chosen.select(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), F.struct(F.col("first.line_no").alias("line_no"), *LINE, "bits").alias("at")).groupBy("doc_id", "th").agg(F.collect_list("at").alias("at"))
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    found = _maybe(source, chosen.select("first.doc_id", "first.th"), ["doc_id", "th"]).join(wanted, ["doc_id", "th"])
    lines = found.withColumn("text", F.split("text", "\n")).select("doc_id", "th", "text", F.explode("at").alias("at"))
    lines = lines.select("at.h1", "at.h2", "at.bits", F.struct("doc_id", "th", F.col("at.line_no").alias("line_no")).alias("first"), _words(F.get("text", "at.line_no")).alias("words"))
    lines = written(lines.withColumn("w", F.size("words")), "lines-words")
    free_shuffles(spark)

    variants = written(_variants(lines), "lines-variants")
    earliest = variants.groupBy("key").agg(F.min(F.struct("first", *LINE)).alias("to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", "to")
    earliest = written(earliest, "lines-earliest")
    pairs = _maybe(variants, earliest, ["key"]).join(earliest, "key").where("first > to.first").select(*LINE, F.col("to.h1").alias("e1"), F.col("to.h2").alias("e2")).distinct()
    other = lines.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("other"))
    near = pairs.join(lines.select(*LINE, "first", "words"), LINE).join(other, ["e1", "e2"]).where(_within_one(F.col("words"), F.col("other"))).select(*LINE, "first").distinct()
    near = written(near, "lines-near")
    drop_written(variants)
    free_shuffles(spark)

    # Lines that occur once and are near no other stay; the rest have a fate.
    fate = distinct.where("n > 1").select(*LINE, "first", F.lit(False).alias("near")).unionByName(near.withColumn("near", F.lit(True)))
    fate = written(fate.groupBy(*LINE).agg(F.min("first").alias("first"), F.max("near").alias("near")), "lines-fate")
    drop_written(distinct)
    free_shuffles(spark)
    judged = _maybe(seen.select("doc_id", "th", "line_no", *LINE), fate, LINE).join(fate, LINE)
    out = judged.where(F.col("near") | (F.col("first") != F.struct("doc_id", "th", "line_no")))
    return out.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with their later near-duplicate lines taken out of the text; every row stays, other columns as they were.

    A text that loses all its lines becomes empty; null texts stay null.
    """
    key, th, cut = spare(docs.columns, "doc", "th", "removed")
    gone = removed_lines(docs, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("removed").alias(cut))
    joined = docs.join(gone, (docs[doc_id] == F.col(key)) & (F.xxhash64(docs[text]) == F.col(th)), "left")
    lines = F.split(text, "\n")
    # The stretches between removed lines, whose numbers are sorted.
    borders = F.concat(F.array(F.lit(-1)), F.col(cut), F.array(F.size(lines)))
    stretches = F.transform(F.sequence(F.lit(1), F.size(cut) + 1), lambda i: F.slice(lines, F.element_at(borders, i) + 2, F.element_at(borders, i + 1) - F.element_at(borders, i) - 1))
    kept = F.array_join(F.flatten(stretches), "\n")
    return joined.withColumn(text, F.when(F.col(cut).isNotNull(), kept).otherwise(F.col(text))).select(*docs.columns)


def op10_deletion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and which of them go, for an earlier line within one word of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_lines(docs)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"))
    out = base.join(gone, ["doc_id", "th"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))


#: The same by strings in place of hashed sums: a variant is a place, the words before it and the words behind it.
ORACLE = r"""
WITH line AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), split AS (
  SELECT doc_id, line_no, list_filter(string_split(lower(regexp_replace(line, '[	
]', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM line
), long AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS spot FROM split WHERE len(words) >= 5
), kind AS (SELECT words, len(words) AS w, min(spot) AS first FROM long GROUP BY words
), place AS (SELECT *, unnest(range(w + 1)) AS i FROM kind
), variant AS (
  SELECT words, first, i, array_to_string(words[1:i], ' ') AS f, array_to_string(words[i + 2:w], ' ') AS b FROM place WHERE i < w
  UNION ALL SELECT words, first, i, array_to_string(words[1:i], ' '), array_to_string(words[i + 1:w], ' ') FROM place
), least AS (SELECT i, f, b, min(first) AS least FROM variant GROUP BY i, f, b
), near AS (SELECT DISTINCT v.words FROM variant v JOIN least m ON v.i = m.i AND v.f = m.f AND v.b = m.b WHERE v.first > m.least
), gone AS (
  SELECT l.doc_id, l.line_no FROM long l JOIN kind k ON l.words = k.words LEFT JOIN near n ON l.words = n.words WHERE n.words IS NOT NULL OR l.spot <> k.first
), told AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(t.n, 0) AS n_removed, coalesce(t.removed, '') AS removed_lines
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id
"""
