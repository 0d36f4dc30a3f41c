"""Line-first quality rules, in DataFrame functions only.

A text is cleaned line by line: a line goes if it reads as navigation (many separators, or a few words
without an end mark), if it is mostly symbols or exclamation, if it is boilerplate of a web page, or if
an equal line stood before it. A text that loses too much with its lines is rejected; so are texts that
are too short or repeat themselves (the base rules).

Words are runs without ASCII white space, lines are split at \\n. Null texts have no words and fail the
base rules. Every row is judged by itself, so rows that repeat are judged alike, an empty table gives no rows,
and a very long text is one row like any other. Of equal lines the first stays. Columns beside doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import documents, read

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of words, in percent, that must be left on good lines.
MIN_LEFT_PERCENT = 60

_SPACE = " \t\n\u000b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: Phrases of web pages, in lower case, for each language of the corpus: a parameter of ``quality``.
BOILERPLATE = {
    "en": (
        "accept cookies", "cookie policy", "enable javascript", "all rights reserved", "terms of use", "terms of service",
        "privacy policy", "click here", "sign up for", "subscribe to our", "skip to content", "back to top",
    ),
    "de": (
        "cookies akzeptieren", "cookie-richtlinie", "javascript aktivieren", "alle rechte vorbehalten", "nutzungsbedingungen",
        "allgemeine geschäftsbedingungen", "datenschutzerklärung", "klicken sie hier", "melden sie sich an", "newsletter abonnieren",
        "zum inhalt springen", "nach oben scrollen",
    ),
    "fr": (
        "accepter les cookies", "politique de cookies", "activer javascript", "tous droits réservés", "conditions d'utilisation",
        "conditions générales d'utilisation", "politique de confidentialité", "cliquez ici", "inscrivez-vous", "abonnez-vous à",
        "aller au contenu", "haut de page",
    ),
    "es": (
        "aceptar cookies", "política de cookies", "habilitar javascript", "todos los derechos reservados", "condiciones de uso",
        "términos del servicio", "política de privacidad", "haga clic aquí", "regístrese", "suscríbase a",
        "saltar al contenido", "volver arriba",
    ),
}


def _without(c: Column, chars: str) -> Column:
    """Code points left when some characters are taken out."""
    return F.length(F.translate(c, chars, ""))


def _line_words(line: Column) -> Column:
    return F.size(F.split(F.btrim(line, F.lit(_SPACE)), _SPLIT))


def line_fails(line: Column, n: Column, low: Column, boilerplate: dict[str, tuple[str, ...]] = BOILERPLATE) -> Column:
    """Rules for one line that has ``n`` words, at least one; ``low`` is its lower-case form.

    Boilerplate of every language counts in every text, as pages mix languages.
    """
    chars = _without(line, _SPACE)
    symbols = F.length(line) - _without(line, _SYMBOLS)
    separators = F.length(line) - _without(line, "|»›•")
    marks = F.length(line) - _without(line, "!?")
    ended = F.btrim(line, F.lit(_SPACE)).rlike("[.!?:;,\"')\\]…”»。]$")
    counted = ((separators >= 2) & (4 * separators >= n)) | (10 * symbols > chars) | ((marks >= 3) & (3 * marks > n))
    return (
        # counting characters is dear: plain prose has none of them
        (line.rlike("[#*$%&|<>»›•!?]") & counted)
        | (~ended & (n < 4))
        | reduce(or_, [low.contains(phrase) for phrases in boilerplate.values() for phrase in phrases], F.lit(False))
    )


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows at sorted positions."""
    gaps = F.aggregate(
        F.sequence(F.lit(1), F.size(positions) - 1),
        F.lit(0),
        lambda total, i: total + F.least(F.lit(3), positions[i] - positions[i - 1]),
    )
    return F.when(F.size(positions) == 0, 0).when(F.size(positions) == 1, 3).otherwise(gaps + 3)


def quality(docs: DataFrame, boilerplate: dict[str, tuple[str, ...]] = BOILERPLATE) -> DataFrame:
    """Counts, verdicts and the cleaned text of every row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    words_left, cleaned, kept.
    """
    text = F.coalesce("text", F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(_SPACE)) != ""
    trimmed = F.btrim(text, F.lit(_SPACE))
    step = documents(docs).select(
        "doc_id",
        text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT)).alias("words"),
        F.filter(F.split(text, "\n"), has_word).alias("lines"),
    )
    step = step.select("doc_id", "text", "lines", "words", F.size("words").alias("n"), F.array_distinct("lines").alias("first_lines"))
    word_chars = F.length(F.array_join("words", ""))
    word = lambda i: F.get("words", i)
    window = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))
    step = step.select(
        "doc_id", "text", "n", "first_lines", word_chars.alias("word_chars"),
        (F.size("lines") - F.size("first_lines")).alias("n_dup_lines"),
        # words and lower case are made once a line, not once for each rule
        F.filter(
            F.transform("first_lines", lambda line: F.struct(line.alias("line"), _line_words(line).alias("n"), F.lower(line).alias("low"))),
            lambda m: ~line_fails(m["line"], m["n"], m["low"], boilerplate),
        ).alias("good"),
        F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), window)).alias("keys"),
    )
    # only texts with a repeated window pay for the sort
    repeats = F.size(F.array_distinct("keys")) < F.size("keys")
    step = step.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    key = lambda i: F.get("sorted", i)["k"]
    twice = lambda i: F.coalesce(key(i) == key(i - 1), F.lit(False)) | F.coalesce(key(i) == key(i + 1), F.lit(False))
    places = F.transform(F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), twice), lambda i: F.get("sorted", i)["i"])
    step = step.withColumn("places", F.when(F.col("sorted").isNotNull(), F.sort_array(places)))
    left = F.aggregate("good", F.lit(0), lambda total, m: total + m["n"])
    step = step.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.when(F.col("text").rlike("[#*$%&|<>]"), F.length("text") - _without(F.col("text"), _SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(_covered(F.col("places"))).cast("long").alias("n_repeat_words"),
        left.cast("long").alias("words_left"),
        F.array_join("good.line", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * F.col("words_left") >= MIN_LEFT_PERCENT * F.col("n_words"))
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).drop("cleaned")


QUERIES = {"op7_quality_rules": op7_quality_rules}

_W = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ORACLE_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PHRASES = "|".join(phrase for phrases in BOILERPLATE.values() for phrase in phrases).replace("'", "''")
ORACLE = {
    "op7_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_W.format("t")} AS words,
  list_filter(string_split(t, chr(10)), lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS lines FROM d),
wins AS (SELECT r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS k
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM wins) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
ln AS (SELECT r, l, len({_W.format("l")}) AS n, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(l) - length(translate(l, '#*$%&|<>', '')) AS symbols,
    length(l) - length(translate(l, '|»›•', '')) AS separators,
    length(l) - length(translate(l, '!?', '')) AS marks,
    regexp_matches(trim(l, {_ORACLE_SPACE}), '[.!?:;,"'')\]…”»。]$') AS ended
  FROM (SELECT DISTINCT r, unnest(lines) AS l FROM w)),
good AS (SELECT r, sum(n) AS words_left FROM ln
  WHERE NOT ((separators >= 2 AND 4 * separators >= n) OR 10 * symbols > chars OR (marks >= 3 AND 3 * marks > n)
    OR (NOT ended AND n < 4) OR regexp_matches(lower(l), '{_PHRASES}')) GROUP BY r),
c AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(words_left, 0) AS BIGINT) AS words_left
  FROM w LEFT JOIN rep USING (r) LEFT JOIN good USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * words_left >= {MIN_LEFT_PERCENT} * n_words AS kept
FROM c"""
}
