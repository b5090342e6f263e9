"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased in A-Z and cut into words. A benchmark item gives one window for every `width` consecutive
words, or a single window when it has fewer. A bit mask over the first words of all windows, a literal of the plan, picks the
positions of a document that may start one; only those are expanded and compared with the windows' full text, so
a hit is exact. Documents are read once and shuffled once, as narrow rows without text.

Defined results: a null or empty text has no words and no hits; items without words have no window, and an empty
table of either kind gives no hits; repeated rows, also of one doc_id with several texts, are judged one by one; items
with equal windows all count; a text of any length is read whole, as an array of its words, which has to fit in a
task; other columns of the inputs, whatever their names, are ignored by `digest` and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import materialize, small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows are broadcast up to this many rows and bytes (a word may be of any length); beyond it the join is shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64 << 20


def words(text: Column) -> Column:
    """Array of a text's words; `lower` is the same on ASCII and much faster than `translate`."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def benchmark_windows(bench: DataFrame, width: int = 10) -> DataFrame:
    """One row for each distinct window: `window` (words joined by a space), `size`, `items` (ids as strings)."""
    w = F.col("w")
    n = F.size(w)
    at = F.when(n >= width, F.sequence(F.lit(0), n - width)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return (
        bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
        .select("item", "w", F.explode(at).alias("i"))
        .select("item", F.slice(w, F.col("i") + 1, width).alias("w"))
        .groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("size"))
        .agg(F.collect_set("item").alias("items"))
    )


#: Bits in a byte of the mask: the bytes are letters, whose number a function tells.
CELL = 6


def _first_words(words: list[Column], bits: int) -> Column:
    """Place in the mask of a window's first words."""
    return F.pmod(F.xxhash64(*words), F.lit(bits))


def _mask(windows: DataFrame, first: int, bits: int) -> Column:
    """A binary literal with a bit for the hash of each window's first words: a task holds it once. It has at most 2**26 bits."""
    k = _first_words([F.element_at(F.split("window", " "), j + 1) for j in range(first)], bits)
    held = windows.select(k.alias("k")).groupBy(F.floor(F.col("k") / CELL).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(k % {CELL} as int))")).alias("v"))
    cells = windows.sparkSession.range(-(-bits // CELL)).join(held, "id", "left")
    letters = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).alias("v")))), lambda c: F.char(c["v"] + 64))
    return F.lit(bytearray(cells.agg(F.array_join(letters, "").alias("m")).first().m.encode()))


def hits(docs: DataFrame, bench: DataFrame, width: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of `docs`: the columns `keep`, n_words, positions (hit words, ascending), items."""
    told = ("n_words", "positions", "items")
    if any(c.lower() in told for c in keep):
        raise ValueError(f"a result column can't be kept: {', '.join(told)}")
    windows = materialize(benchmark_windows(bench, width), "windows")
    size = windows.agg(F.count(F.lit(1)), F.min("size"), F.collect_set("size"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()  # the set has at most `width` values
    n_windows, least, sizes = size[0], size[1] or 1, sorted(size[2] or [])
    first = min(3, least)
    bits = min(1 << 26, max(1 << 16, 1 << (16 * n_windows + 1).bit_length()))
    names, keep = keep, tuple(f"_keep{k}" for k in range(len(keep)))  # names of its own can't clash
    slim = docs.select(*[F.col(c).alias(k) for c, k in zip(names, keep, strict=True)], F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_rid"))
    slim = slim.select(*keep, "_rid", words(F.col("_text")).alias("_w"))
    mask = _mask(windows, first, bits)
    # A row for each word and, in front of them, one for the document, which stays. Most words go in the same generated loop.
    k = _first_words([F.get("_w", F.col("_at") + j - 1) for j in range(first)], bits)
    cell = F.ascii(F.substring(mask, F.floor(k / CELL).cast("int") + 1, F.lit(1)).cast("string"))
    starts = slim.select(*keep, "_rid", "_w", F.posexplode(F.concat(F.array(F.lit("")), "_w")).alias("_at", "_word")).where((F.col("_at") == 0) | (F.getbit(cell, (k % CELL).cast("int")) == 1))
    starts = starts.select(*keep, "_rid", F.size("_w").alias("n_words"), (F.col("_at") - 1).alias("_at"), F.slice("_w", F.greatest("_at", F.lit(1)), max(sizes, default=1)).alias("_next"))
    lengths = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda z: (F.col("_at") >= 0) & (z <= F.size("_next")))
    spans = F.transform(lengths, lambda z: F.struct(F.col("_at").alias("i"), z.alias("z"), F.array_join(F.slice("_next", 1, z), " ").alias("window")))
    tried = (
        starts.select(*keep, "_rid", "n_words", F.explode_outer(spans).alias("_c"))
        .select(*keep, "_rid", "n_words", F.col("_c.i").alias("_i"), F.col("_c.z").alias("_z"), F.col("_c.window").alias("_window"))
    )
    known = windows.select(F.col("window").alias("_window"), F.col("items").alias("_items"))
    if n_windows <= BROADCAST_WINDOWS and size[3] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    else:  # documents without a candidate must not meet under one key; no window holds a zero byte
        tried = tried.withColumn("_window", F.coalesce("_window", F.concat(F.lit("\0"), F.col("_rid").cast("string"))))
    found = tried.join(known, "_window", "left")
    span = F.when(F.col("_items").isNotNull(), F.struct("_i", "_z"))
    return (
        found.groupBy("_rid")
        .agg(*[F.first(c).alias(c) for c in keep], F.first("n_words").cast("long").alias("n_words"), F.collect_set(span).alias("_spans"), F.collect_set("_items").alias("_found"))
        .select(
            *[F.col(k).alias(c) for c, k in zip(names, keep, strict=True)],
            "n_words",
            F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["_i"], s["_i"] + s["_z"] - 1))))).alias("positions"),
            F.array_sort(F.array_distinct(F.flatten("_found"))).alias("items"),
        )
    )


def digest(found: DataFrame) -> DataFrame:
    """The reported columns of `hits`."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("positions") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = 10, mode: str = "document") -> DataFrame:
    """`docs` without what leaks from `bench`: whole documents, or with mode "span" only the hit words.

    All columns of `docs` are kept, which may have any names. A removed word takes the separators before it along.
    """
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_key"))
    found = hits(keyed.select("_id", "_key", "text"), bench, width, ("_id", "_key")).where(F.size("positions") > 0)
    found = materialize(found.select(F.col("_id").alias("_hit_id"), F.col("_key").alias("_hit_key"), F.col("positions").alias("_at")).dropDuplicates(["_hit_id", "_hit_key"]), "hits")
    same = keyed["_id"].eqNullSafe(F.col("_hit_id")) & (keyed["_key"] == F.col("_hit_key"))
    if mode == "document":
        return keyed.join(small(found.drop("_at")), same, "left_anti").select("_row.*")
    found = keyed.join(small(found, 100_000), same, "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    # Words and separators alternate; an empty leading word stands for a text that starts with separators.
    parts = found.withColumn("_seps", F.array_remove(F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).withColumn("_ws", F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))
    led = text.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    sep = lambda i: F.coalesce(F.get("_seps", F.when(led, i).otherwise(i - 1)), F.lit(""))
    kept = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_ws") - 1), lambda i: ~F.array_contains("_at", i)),
        lambda i: F.concat(F.when(led | (i > 0), sep(i)).otherwise(F.lit("")), F.get("_ws", i)),
    )
    tail = F.coalesce(F.when(F.size("_ws") > 0, F.get("_seps", F.when(led, F.size("_ws")).otherwise(F.size("_ws") - 1))), F.lit(""))
    cleaned = F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return parts.select(*[cleaned.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item, len(w[i:i+9]) z, array_to_string(w[i:i+9], ' ') win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) i FROM b)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
z AS (SELECT DISTINCT z FROM bw),
dw AS (SELECT doc_id, i, z, array_to_string(w[i:i+z-1], ' ') win FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) i FROM d, z)),
h AS (SELECT doc_id, i, dw.z, item FROM dw JOIN bw ON dw.win = bw.win AND dw.z = bw.z),
p AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
