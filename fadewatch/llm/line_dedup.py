"""Near-duplicate lines by a join of deletion neighbourhoods; DataFrame functions only.

A line's words are what white space separates. Two lines are near if one word insertion, deletion or substitution makes
their words equal, and both have MIN_WORDS words. A line that equals, or is near to, a line that stands earlier in the
corpus (by doc_id, then line number; nulls first) is dropped. Blank lines stay.

1. Equal lines are combined to their earliest place by a hash aggregate, so copies never meet in one task.
2. Lines within one edit share their first or their last half of words. Lines whose halves nobody shares cannot have a
   near line; they are left out here, which loses nothing.
3. The others emit their deletion neighbourhood: a key for the whole line and keys for each word left out. Keys are sums
   of hashes of (word, place), so running sums give all keys of a line in linear time.
4. Per key only the earliest lines are kept by an aggregate; every line meets just these, never all lines of the key.
5. What meets is verified word by word, and the later line is dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import scratch, staged, text_key

MIN_WORDS = 8


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def split_words(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(" \t\r\x0b\f")), r"[ \t\r\x0b\f]+")


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^ \t\r\x0b\f]")


def _same_text(a: str, b: str) -> Column:
    """Rows of one document: equal text, and equal doc_id or none."""
    keys = (F.col(f"{a}.text_key1") == F.col(f"{b}.text_key1")) & (F.col(f"{a}.text_key2") == F.col(f"{b}.text_key2"))
    return keys & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def _half_keys(words: Column, n: Column) -> Column:
    """Hashes of the first and last h words for h = floor((n - 1) / 2) and floor(n / 2)."""
    few, many = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    keys = [F.xxhash64(F.lit(side), h, F.slice(words, start, h)) for h in (few, many) for side, start in (("first", F.lit(1)), ("last", n - h + 1))]
    return F.array_distinct(F.array(*keys))


def earliest_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each distinct non-blank line: its key, its earliest place and the keys of its halves."""
    lines = docs.select("doc_id", "text_key1", "text_key2", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    lines = lines.filter(~is_blank(F.col("line")))
    place = F.min(F.struct("doc_id", "text_key1", "text_key2", "line_no")).alias("place")
    words = lines.withColumn("words", split_words(F.col("line")))
    halves = F.when(F.size("words") >= min_words, _half_keys(F.col("words"), F.size("words")))
    keyed = words.select("doc_id", "text_key1", "text_key2", "line_no", F.xxhash64("line").alias("key1"), F.xxhash64(F.lit(7), "line").alias("key2"), halves.alias("halves"))
    return keyed.groupBy("key1", "key2").agg(place, F.first("halves").alias("halves"))


def lines_with_partners(first: DataFrame) -> DataFrame:
    """Places of the lines that share a half with another line."""
    halves = first.filter(F.col("halves").isNotNull()).select("key1", F.explode("halves").alias("half"))
    shared = staged(halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"))
    keys = halves.join(shared, "half", "left_semi").select("key1").distinct()
    return first.join(keys, "key1", "left_semi").select("place.*")


def with_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The words of the lines at ``places``, numbered in the order of the corpus."""
    wanted = places.groupBy("doc_id", "text_key1", "text_key2").agg(F.collect_set("line_no").alias("wanted"))
    rows = docs.alias("d").join(wanted.alias("w"), _same_text("d", "w")).select("d.doc_id", "d.text_key1", "d.text_key2", split_lines(F.col("d.text")).alias("lines"), F.explode("w.wanted").alias("line_no"))
    rows = rows.select("doc_id", "text_key1", "text_key2", "line_no", split_words(F.col("lines")[F.col("line_no")]).alias("words"))
    rows = rows.dropDuplicates(["doc_id", "text_key1", "text_key2", "line_no"]).orderBy("doc_id", "text_key1", "text_key2", "line_no")
    return staged(rows.withColumn("line_id", F.monotonically_increasing_id()))


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """Rows (line_id, n, at, low, high, role): the line itself (at 0), and it without word ``at``.

    ``sub`` keys meet lines of the same length that miss the same word, ``del`` keys meet whole lines one word shorter.
    """
    n = F.size("words")
    each = lines.select("line_id", n.alias("n"), F.posexplode("words").alias("k", "word")).withColumn("k", F.col("k") + 1)
    for name, at in (("here", F.col("k")), ("moved", F.col("k") - 1)):
        h = F.xxhash64("word", at)
        each = each.withColumns({f"{name}_low": h.bitwiseAND(F.lit(0x7FFFFFFF)), f"{name}_high": F.shiftrightunsigned(h, 33)})
    w = Window.partitionBy("line_id").orderBy("k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    both = Window.partitionBy("line_id")

    def sums(half: str) -> tuple[Column, Column]:
        total = F.sum(f"moved_{half}").over(both)
        upto = F.sum(f"moved_{half}").over(w)
        gone = F.coalesce(F.sum(f"here_{half}").over(before), F.lit(0)) + total - upto
        return gone, F.sum(f"here_{half}").over(both)

    (low, all_low), (high, all_high) = sums("low"), sums("high")
    each = each.select("line_id", "n", "k", low.alias("low"), high.alias("high"), all_low.alias("all_low"), all_high.alias("all_high"))

    def key(role: str, length: Column, at: Column, low: str, high: str) -> Column:
        return F.struct(F.lit(role).alias("role"), length.alias("length"), at.alias("at"), F.col(low).alias("low"), F.col(high).alias("high"))

    whole = key("own", F.col("n"), F.lit(0), "all_low", "all_high")
    sub, cut = key("sub", F.col("n"), F.col("k"), "low", "high"), key("del", F.col("n") - 1, F.lit(0), "low", "high")
    return each.select("line_id", F.explode(F.when(F.col("k") == 1, F.array(whole, sub, cut)).otherwise(F.array(sub, cut))).alias("key")).select("line_id", "key.*")


def within_one_word(a: Column, b: Column) -> Column:
    """Whether one word insertion, deletion or substitution, or none, turns words ``a`` into ``b``."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    same = F.zip_with(F.slice(a, 1, short), F.slice(b, 1, short), lambda x, y: x == y)
    at = F.array_position(same, F.lit(False)).cast("int")
    at = F.when(at == 0, short + 1).otherwise(at)
    rest_a, rest_b = F.slice(a, at + F.when(n >= m, 1).otherwise(0), n), F.slice(b, at + F.when(m >= n, 1).otherwise(0), m)
    return (F.abs(n - m) <= 1) & ((a == b) | (rest_a == rest_b))


def later_near_lines(lines: DataFrame) -> DataFrame:
    """line_id of each line that is near to an earlier one."""
    keys = neighbourhoods(lines)
    by = ["length", "at", "low", "high"]
    any_line, own = F.min("line_id").alias("first_any"), F.min(F.when(F.col("role") == "own", F.col("line_id"))).alias("first_own")
    heads = staged(keys.groupBy(*by).agg(any_line, own, F.max("line_id").alias("last")).filter("first_any < last").drop("last"))
    met = keys.join(heads, by)
    rival = F.when(F.col("role") == "del", F.col("first_own")).otherwise(F.col("first_any"))
    pairs = met.select("line_id", rival.alias("rival")).filter("rival < line_id").distinct()
    a, b = lines.select("line_id", "words"), lines.select(F.col("line_id").alias("rival"), F.col("words").alias("rival_words"))
    return pairs.join(a, "line_id").join(b, "rival").filter(within_one_word(F.col("words"), F.col("rival_words"))).select("line_id").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later equal and near lines taken out of ``text``, and n_lines, n_kept.

    Needs doc_id and text; every other column is kept, but for ones named n_lines or n_kept, which are replaced. A null
    text stays null with 0 lines; a text whose lines all repeat becomes empty; documents never go. Rows that agree in
    doc_id and text count as one place and keep the same lines; null doc_ids come first. Texts that lose nothing are
    returned unchanged.
    """
    docs = docs.drop("n_lines", "n_kept")
    keyed = docs.withColumns(dict(zip(("text_key1", "text_key2"), text_key(), strict=True)))
    slim = keyed.select("doc_id", "text", "text_key1", "text_key2")
    with scratch(docs.sparkSession):
        first = staged(earliest_lines(slim, min_words))
        lines = with_words(slim, lines_with_partners(first))
        near = lines.join(later_near_lines(lines), "line_id", "left_semi").select("doc_id", "text_key1", "text_key2", "line_no")
        kept = first.select("place.*").alias("f").join(near.alias("n"), _same_text("f", "n") & (F.col("f.line_no") == F.col("n.line_no")), "left_anti")
        kept = staged(kept.groupBy("doc_id", "text_key1", "text_key2").agg(F.collect_set("line_no").alias("kept")), keep=True)
    return _with_kept_lines(docs, keyed, kept)


def _with_kept_lines(docs: DataFrame, keyed: DataFrame, kept: DataFrame) -> DataFrame:
    rows = keyed.alias("d").join(kept.alias("k"), _same_text("d", "k"), "left").select("d.*", F.coalesce("k.kept", F.array().cast("array<int>")).alias("kept"))
    rows = rows.withColumn("lines", split_lines(F.col("text")))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(is_blank(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("kept", F.array_sort(F.concat("kept", F.coalesce(blank, F.array().cast("array<int>")))))
    text = F.when(F.size("kept") == F.size("lines"), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n"))
    text = F.when(F.col("text").isNotNull(), text)
    counts = [F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size("kept")).alias("n_kept")]
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], *counts)
