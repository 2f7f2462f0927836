"""Line-first cleaning: judge each line, then the document by what is left of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Fixed values.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"""[.!?:;,…。！？)\]"'»”’]\s*$"""
SEPARATORS = r"(?:^|\s)[|·•»›>/](?=\s|$)"
BOILERPLATE = (
    r"(?i)(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie (?:policy|settings|consent)"
    r"|(?:enable|requires?) javascript|lorem ipsum|click here|sign up (?:now|for)|subscribe (?:now|to)"
    r"|skip to (?:main )?content|back to top|share (?:this|on)|log ?in to (?:your|continue)|©|&copy;)"
)
MIN_WORDS, LEAST_LEFT, BOILERPLATE_WORDS = 50, 0.5, 30


def _no_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def bad_line(line: Column) -> Column:
    """True for a line that is navigation, symbols, boilerplate or a short unpunctuated scrap."""
    n = F.length(_no_blanks(line))
    n_words = F.size(F.split(F.btrim(line, F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    return (
        ((separators >= 3) & (separators * 4 >= n_words))
        | (symbols * 10 > n)
        | ((n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
        | ((n_words < 3) & ~line.rlike(SENTENCE_END))
    )


def judge(docs: DataFrame) -> DataFrame:
    """Base counts and the verdict of every whole text, with built-in functions only.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    left_chars (code points in words of the lines that pass), cleaned (those
    lines), base_failed and kept.  A null or blank text has no words, so it fails.
    Rows are judged each, repeated ones too; other columns pass through unless
    they have one of these names, which are replaced.  An empty table stays so.
    """
    keep = [c for c in docs.columns if c.lower() not in _OWN]
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"), words(F.col("text")).alias("_words"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: _no_blanks(line) != ""))
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(3)])
    df = df.withColumn("_windows", F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(twice, pairs))
    near = lambda i: F.get(F.col("_sorted"), i)["h"]
    again = F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == near(i - 1), F.lit(False)) | F.coalesce(x["h"] == near(i + 1), F.lit(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    # a window covers three words, or as many as there are before the next one begins
    covers = F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(3))))
    good = F.array_join(F.filter("_lines", lambda line: ~bad_line(line)), "\n")
    df = df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(_no_blanks(F.col("_text"))).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        good.alias("cleaned"),
    )
    df = df.withColumn("left_chars", F.length(_no_blanks(F.col("cleaned"))).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("left_chars") >= F.col("word_chars") * LEAST_LEFT))


_OWN = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "left_chars", "base_failed", "kept", "_text", "_words", "_lines", "_windows", "_sorted", "_at"}

#: DuckDB SQL for the columns of op7, from table documents.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM w),
m AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS n,
             len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw,
             len(regexp_extract_all(replace(line, ' ', '  '), '(?:^|\s)[|·•»›>/](?:\s|$)')) AS sep,
             length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym FROM l),
c AS (SELECT doc_id, sum(n) AS n FROM m
      WHERE NOT ((sep >= 3 AND sep * 4 >= nw) OR sym * 10 > n OR (nw <= 30 AND regexp_matches(line, '__BOILERPLATE__'))
                 OR (nw < 3 AND NOT regexp_matches(line, '__END__'))) GROUP BY doc_id),
o AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, coalesce(c.n, 0) AS left_chars
      FROM w LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_chars >= word_chars * 0.5 AS kept
FROM o""".replace("__BOILERPLATE__", BOILERPLATE).replace("__END__", SENTENCE_END.replace("'", "''"))
