"""Benchmark passages in documents, by winnowing; DataFrame functions alone.

Of every ``WINDOW`` consecutive word grams the one with the least hash is kept, in documents and items
alike. A run of ``SPAN`` words holds just that many grams, so two equal runs keep the same gram at the same
place: no shared run of ``SPAN`` words is missed. Kept grams are joined on their hashes, and each hit is extended:
the runs of ``SPAN`` words around it are joined, as words, with the runs of the items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from labelvec.session import broadcast_if_small, stage

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Whatever lies between words; the text is in lower case by then.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A kept gram is 31 bits of hash before as many bits of its place; runs are compared as words later.
PLACE_BITS = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z only); null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def _each(n: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """``body`` of 0..n-1; none if n is not positive."""
    some = F.transform(F.sequence(F.lit(0), n - 1), body)
    return F.when(n > 0, some).otherwise(F.array().cast(f"array<{kind}>"))


def winnowed(words: Column) -> Column:
    """Kept grams of a text as ``hash << 32 | place``, with 31 bits of hash.

    The number orders grams by hash and then by place, so of equal ones the first is kept.
    """

    def grams(hashes: Column) -> Column:
        def one(i: Column) -> Column:
            gram = F.xxhash64(*[F.get(hashes, i + k) for k in range(GRAM)])
            return F.shiftleft(F.shiftrightunsigned(gram, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(i.cast("long"))

        return _each(F.size(hashes) - (GRAM - 1), one, "bigint")

    def least(values: Column) -> Column:
        window = lambda i: F.least(*[F.get(values, i + k) for k in range(WINDOW)])
        return F.array_distinct(_each(F.size(values) - (WINDOW - 1), window, "bigint"))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), least)


def _window(words: Column, start: Column, n: Column | int) -> Column:
    """``n`` words from ``start`` on; words hold no space."""
    return F.array_join(F.slice(words, start + 1, F.lit(n) if isinstance(n, int) else n), " ")


def item_windows(items: DataFrame) -> DataFrame:
    """(n, window, item): every distinct run of ``SPAN`` words of the items; a shorter item is one run."""

    def runs(words: Column) -> Column:
        n = F.least(F.size(words), F.lit(SPAN))
        count = F.when(n == 0, 0).otherwise(F.size(words) - n + 1)
        return _each(count, lambda i: F.struct(n.alias("n"), _window(words, i, n).alias("window")), "struct<n:int,window:string>")

    rows = items.select(F.col("item_id").cast("string").alias("item"), F.explode(let(words_of(F.col("text")), runs)).alias("r"))
    return rows.select("r.n", "r.window", "item").distinct()


def _marks(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, key, n_words, marks, short): kept grams, and hashes of all runs of the short items' ``lengths``."""

    def runs(words: Column, n: int) -> Column:
        one = lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.xxhash64(_window(words, i, n)).alias("hash"))
        return _each(F.size(words) - (n - 1), one, "struct<n:int,at:int,hash:bigint>")

    def row(words: Column) -> Column:
        short = [runs(words, n) for n in lengths]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            winnowed(words).alias("marks"),
            (F.concat(*short) if short else F.array().cast("array<struct<n:int,at:int,hash:bigint>>")).alias("short"),
        )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), let(words_of(F.col("text")), row).alias("r"))
    return stage(found.select("doc_id", "key", "r.n_words", "r.marks", "r.short"), "marks")


def _candidates(marked: DataFrame, windows: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, doc_id, n, at): grams that some item keeps too, and runs that hash like a short item; a text once."""
    kept = items.select(F.explode(winnowed(words_of(F.col("text")))).alias("m"))
    kept = kept.select(F.shiftright("m", PLACE_BITS).alias("hash")).distinct()
    grams = marked.select("key", "doc_id", F.explode("marks").alias("m")).select(
        "key", "doc_id", F.lit(SPAN).alias("n"), F.col("m").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("at"),
        F.shiftright("m", PLACE_BITS).alias("hash"),
    )
    found = grams.join(broadcast_if_small(kept), "hash", "left_semi").drop("hash")
    if lengths:
        short = windows.where(F.col("n") < SPAN).select("n", F.xxhash64("window").alias("hash")).distinct()
        runs = marked.select("key", "doc_id", F.inline("short"))
        found = found.union(runs.join(broadcast_if_small(short), ["n", "hash"], "left_semi").select("key", "doc_id", "n", "at"))
    places = F.collect_set(F.struct("n", "at")).alias("places")
    return stage(found.groupBy("key").agg(F.min("doc_id").alias("doc_id"), places), "candidates")


def _extended(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, start, n, window): the runs of words that hold a candidate, from the text itself."""

    def runs(words: Column) -> Column:
        def around(p: Column) -> Column:
            gram = F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.struct(p["n"].alias("n"), (p["at"] - k).alias("at")))
            return F.when(p["n"] == SPAN, gram).otherwise(F.array(F.struct(p["n"].alias("n"), p["at"].alias("at"))))

        inside = lambda p: (p["at"] >= 0) & (p["at"] + p["n"] <= F.size(words))
        places = F.filter(F.array_distinct(F.flatten(F.transform("places", around))), inside)
        return F.transform(places, lambda p: F.struct(p["at"].alias("start"), p["n"].alias("n"), _window(words, p["at"], p["n"]).alias("window")))

    texts = docs.select(F.col("doc_id").cast("long").alias("of"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    wanted = candidates.select(F.col("key").alias("wanted"), F.col("doc_id").alias("first"))
    # One row of each text is enough; a text without any doc_id is found by its key alone.
    here = (F.col("key") == F.col("wanted")) & F.col("of").eqNullSafe(F.col("first"))
    texts = texts.join(broadcast_if_small(wanted), here, "left_semi")
    both = texts.select("key", "text").join(candidates.drop("doc_id"), "key")
    return both.select("key", F.inline(let(words_of(F.col("text")), runs)))


def _union(spans: Column) -> Column:
    """Sorted ranges (start, n) as ranges [first, last) that neither overlap nor touch."""
    one = "struct<first:int,last:int>"

    def add(done: Column, s: Column) -> Column:
        end = F.try_element_at(done, F.lit(-1))
        new = F.struct(s["start"].alias("first"), (s["start"] + s["n"]).alias("last"))
        grown = F.struct(end["first"].alias("first"), F.greatest(end["last"], s["start"] + s["n"]).alias("last"))
        joins = (F.size(done) > 0) & (end["last"] >= s["start"])
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{one}>"), add)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every row of ``docs`` (doc_id, text, ...) against ``items`` (item_id, text, ...).

    Words are runs of letters and digits in lower case (A-Z) and of all characters beyond ASCII. A word is
    hit inside a run of ten words that some item holds too; an item of fewer words, but not none, is one run. ``spans`` are
    the word ranges [first, last) of hit words, ``items`` the item_ids whose runs occur, as strings in order.
    Null and blank texts have no words and no hits; texts of any length are taken whole. Rows that repeat a text are
    looked up once and get equal results. Repeated item_ids count as one item with the runs of all its rows; rows without an
    item_id mark words but are not listed. Without documents there are no rows, without items no hits.

    Only the documents' kept grams are joined; texts are read again only where one of them hits. Runs that the
    same items hold share one list of items, and documents that hit the same lists share one union, so a passage in very
    many documents and items is no product of both.
    """
    windows = stage(item_windows(items), "windows")
    lengths = sorted(r["n"] for r in windows.where(F.col("n") < SPAN).select("n").distinct().collect())  # 9 at most
    marked = _marks(docs, lengths)
    candidates = _candidates(marked, windows, items, lengths)
    held = windows.groupBy("n", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = stage(held.withColumn("list", F.md5(F.to_json("items"))), "held")
    runs = _extended(docs, candidates).join(broadcast_if_small(held.drop("items")), ["n", "window"])
    found = runs.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("runs"), F.array_sort(F.collect_set("list")).alias("lists"))
    found = found.select("key", _union(F.col("runs")).alias("spans"), "lists", F.md5(F.concat_ws(",", "lists")).alias("mixed"))
    found = stage(found, "found")
    lists = held.groupBy("list").agg(F.first("items").alias("items"))
    mixes = found.groupBy("mixed").agg(F.first("lists").alias("lists")).select("mixed", F.explode("lists").alias("list"))
    mixes = mixes.join(broadcast_if_small(lists), "list").select("mixed", F.explode_outer("items").alias("item"))
    mixes = mixes.groupBy("mixed").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = stage(found.join(broadcast_if_small(mixes), "mixed").select("key", "spans", "items"), "leaks")
    out = marked.select("doc_id", "key", "n_words").join(broadcast_if_small(found), "key", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return out.select(
        "doc_id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item, n, run FROM (
    SELECT item, least(len(w), 10) AS n,
      unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS run
    FROM b WHERE len(w) > 0)),
own AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2),
    lambda i: array_to_string(w[i:i + n - 1], ' '))) AS run
  FROM d, (SELECT DISTINCT n FROM runs) WHERE len(w) >= n),
hit AS (SELECT r, s, n, item FROM own JOIN runs USING (n, run)),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""
