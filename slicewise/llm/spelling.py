"""Spelling variants: words one edit apart, by bands of letter-parity masks.

A word's mask has a bit for each letter (26 and 64 more), set if the letter occurs an
odd number of times. One inserted or deleted letter flips one bit, a replaced one flips
two, so of three bands of the mask at least one is equal. Words join on an equal band.

A band alone takes a share of the vocabulary that doesn't shrink as it grows, so a band's
group is split by what an edit leaves: of the shorter word's length, one edit lies either
behind the first half or before the second, and that half is part of the key. A word
hence has six keys (a band and a half), at its own length and, as the longer of two, at
one less, which is the length filter. A pair is taken at the first key that it shares and
verified by its edit distance. What meets in a join are words with the same half and
band; no group's pairs are made beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import freeze

RUN = r"[A-Za-zÀ-ÿ]"
BANDS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, drop_every: int | None = None) -> DataFrame:
    """One row (word) for each maximal run of letters that gives a word of at least ``least_letters`` code points.

    Only A-Z are lower-cased. With ``drop_every``, a run loses the code point ``h % length`` where that number
    divides h, the CRC-32 of ``<id>:<lower-cased run>``; a null id is written as nothing. Null texts have no words.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{RUN}{{{least_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if not drop_every:
        return rows.select(F.col("run").alias("word"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    rows = rows.select(F.when(F.pmod("h", F.lit(drop_every)) == 0, less).otherwise(F.col("run")).alias("word"))
    return rows.where(F.length("word") >= least_letters)


def _masked(words: DataFrame) -> DataFrame:
    """Adds m, the word's length, and its mask's bands; letters are dealt to the bands in turn."""
    code = F.transform(F.split("word", ""), lambda c: F.ascii(c))
    letters = F.transform(F.filter(code, lambda c: c > 0), lambda c: F.when(c < 128, c - 97).otherwise(c - 0xC0 + 26))
    band = "aggregate(letters, 0, (mask, i) -> if(i % {n} = {b}, mask ^ shiftleft(1, cast(i div {n} as int)), mask))"
    masked = words.select("word", F.length("word").alias("m"), letters.alias("letters"))
    return masked.select("word", "m", *[F.expr(band.format(n=BANDS, b=b)).alias(f"band{b}") for b in range(BANDS)])


def _half(word: Column, m: Column, side: int) -> Column:
    """Of m code points the first half, or from the end the rest."""
    half = F.floor(m / 2).cast("int")
    return F.substring(word, half - m, m - half) if side else F.substring(word, F.lit(1), half)


def _keyed(masked: DataFrame, less: int = 0) -> DataFrame:
    """A row for each key of a word, at ``less`` under its length; way tells the band and the half."""
    m = (F.col("m") - less).cast("int")
    keys = [F.xxhash64(F.lit(2 * b + side), m, f"band{b}", _half(F.col("word"), m, side)) for b in range(BANDS) for side in (0, 1)]
    return masked.select("word", m.alias("m"), *[f"band{b}" for b in range(BANDS)], F.posexplode(F.array(*keys)).alias("way", "key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near), once for each two words of column word, which are distinct, that differ by one edit."""
    masked = freeze(_masked(words), "spelling_masks")
    own, longer = _keyed(masked), _keyed(masked, 1)

    def joined(left: DataFrame, same_length: bool) -> DataFrame:
        x, y = left.alias("x"), own.alias("y")
        equal = [F.col(f"x.band{b}") == F.col(f"y.band{b}") for b in range(BANDS)]
        first = F.when(equal[0], 0).when(equal[1], 1).when(equal[2], 2)
        side = F.when(_half(F.col("x.word"), F.col("x.m"), 0) == _half(F.col("y.word"), F.col("x.m"), 0), 0).otherwise(1)
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.way") == F.col("y.way")) & (F.col("x.m") == F.col("y.m")) & (F.col("x.way") == 2 * first + side)
        if same_length:
            on &= F.col("x.word") < F.col("y.word")
        on &= F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
        return x.join(y, on).select(F.col("x.word").alias("word"), F.col("y.word").alias("near"))

    return joined(own, True).unionByName(joined(longer, False))


def spelling_variants(words: DataFrame, least_count: int = 5, dominance: int = 5) -> DataFrame:
    """One row per distinct word of column word that occurs ``least_count`` times: word, form, root, n, n_near, form_n.

    Words are near if they differ by one inserted, deleted or replaced code point. ``form`` is the near word of
    largest n, of equal ones the smallest in code point order, if it has ``dominance`` times the word's n or more;
    ``root`` follows forms to the last. Without a form, form and form_n are null and root is the word. Null words
    are ignored; an empty table gives an empty result. Words consist of a-z and U+00C0 to U+00FF.
    A ``dominance`` of 1 or less is refused, as words of equal count would be each other's form.
    """
    if dominance <= 1:
        raise ValueError("dominance must be over 1")
    counted = freeze(words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count), "spelling_words")
    pairs = freeze(near_pairs(counted.select("word")), "spelling_pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    rated = both.join(counted.withColumnsRenamed({"word": "near", "n": "near_n"}), "near")
    best = rated.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= dominance * F.col("n")
    out = freeze(out.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}), "spelling_forms")
    # forms are more frequent each time, so paths end; each round doubles what a word has followed
    last = freeze(out.where("form is not null").select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        ahead = last.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = freeze(last.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        last = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql(least_letters: int = 6, least_count: int = 5, dominance: int = 5, drop_every: int = 199) -> str:
    """DuckDB SQL for the same rows of ``documents``: CRC-32 by its bits, near words by what a deletion leaves."""
    return rf"""
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ),
        runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{RUN}{{{least_letters},}}')), '{UPPER}', '{LOWER}') AS run FROM documents
        ),
        distinct_runs AS (SELECT id, run, count(*) AS times FROM runs GROUP BY ALL),
        bytes AS (
            SELECT id, run, times, list_transform(string_split(id || ':' || run, ''), lambda c: unicode(c)) AS codes FROM distinct_runs
        ),
        hashed AS (
            SELECT run, times, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(flatten(list_transform(codes, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END)) AS BIGINT[])),
                                  lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h
            FROM bytes, crc_table
        ),
        words AS (
            SELECT CASE WHEN h % {drop_every} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
        ),
        counted AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= {least_letters} GROUP BY word HAVING sum(times) >= {least_count}
        ),
        less AS (
            SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM counted, unnest(range(1, length(word) + 1)) AS u(i)
        ),
        near AS (
            SELECT x.word, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
            UNION SELECT x.word, y.word, y.n FROM less x JOIN counted y ON x.rest = y.word
            UNION SELECT y.word, x.word, x.n FROM less x JOIN counted y ON x.rest = y.word
        ),
        best AS (
            SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM near
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
        ),
        forms AS (
            SELECT c.word, c.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {dominance} * c.n THEN b.near END AS form, CASE WHEN b.near_n >= {dominance} * c.n THEN b.near_n END AS form_n
            FROM counted c LEFT JOIN best b USING (word)
        ),
        paths AS (
            SELECT word, word AS root FROM forms
            UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL
        ),
        roots AS (SELECT p.word, p.root FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
    """
