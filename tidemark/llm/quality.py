"""Operator 4: quality rules, line first. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty, words

#: Fixed values of the line rules; Java and RE2 read these patterns alike.
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Marks that a finished line ends in, and the white space that may follow them.
END_MARKS, BLANK = """.!?;:…。！？)"'”’»]""", " \t\n\v\f\r"
SEPARATORS = r"[|>»›•·]"
#: What page furniture says in English, German, French and Spanish; lines are compared with A-Z as a-z.
PHRASES = (
    "all rights reserved", "privacy policy", "cookie policy", "use of cookies", "terms of (use|service)", "enable javascript", "lorem ipsum", "subscribe to our", "sign (in|up) to", "click here", "read more", "powered by", "skip to (main )?content",
    "alle rechte vorbehalten", "datenschutzerkl", "cookie-richtlinie", "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren", "hier klicken", "weiterlesen", "zum inhalt springen",
    "tous droits r.serv.s", "politique de confidentialit", "utilisation de cookies", "conditions d'utilisation", "activer javascript", "abonnez-vous", "cliquez ici", "lire la suite", "aller au contenu",
    "todos los derechos reservados", "pol.tica de (privacidad|cookies)", "uso de cookies", "t.rminos de (uso|servicio)", "active javascript", "suscr.bete", "haga clic", "leer m.s", "saltar al contenido",
)
#: Grouped by their first letter, so that few branches are tried at each place of a line.
BOILERPLATE = "|".join(f"{c}(?:{'|'.join(p[1:] for p in PHRASES if p[0] == c)})" for c in sorted({p[0] for p in PHRASES}))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Quotations, whose marks separate nothing. A line with a letter that is small or of a script without cases is not shouted.
QUOTED, SMALL = (r"«([^«»]*)»", r"»([^«»]*)«"), r"[\p{Ll}\p{Lo}]"
#: A line of fewer words must end in a mark; separators of a navigation line; a boilerplate line has fewer characters;
#: a document loses at most this share of its lines' characters.
LEAST_WORDS, LEAST_SEPARATORS, BOILERPLATE_CHARS, MOST_LOST = 5, 4, 200, 0.5
#: Navigation has a separator, shouting an exclamation mark, for so many words at least.
WORDS_A_MARK = 4


def line_fails(line: F.Column) -> F.Column:
    """Whether a line with a word breaks a rule: short without an end mark, navigation, boilerplate, symbols for a tenth
    of its characters, or shouting. Navigation and shouting go by marks per word, so that a long line of prose is neither.
    Cheap conditions stand first and spare most lines the others."""
    n_words = F.regexp_count(line, F.lit(f"{WORD}+"))
    unfinished = ~F.contains(F.lit(END_MARKS), F.right(F.rtrim(line, F.lit(BLANK)), F.lit(1))) & (n_words < LEAST_WORDS)
    bare = line
    for quoted in QUOTED:
        bare = F.regexp_replace(bare, quoted, "$1")
    separators = F.regexp_count(bare, F.lit(SEPARATORS))
    navigation = (F.regexp_count(line, F.lit(SEPARATORS)) >= LEAST_SEPARATORS) & (separators >= LEAST_SEPARATORS) & (separators * WORDS_A_MARK >= n_words)
    boilerplate = (F.length(line) < BOILERPLATE_CHARS) & F.rlike(F.translate(line, UPPER, LOWER), F.lit(BOILERPLATE))
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 10 > F.length(line)
    shouts = F.regexp_count(line, F.lit("!"))
    shouting = F.contains(line, F.lit("!")) & (shouts >= 3) & ~F.rlike(line, F.lit(SMALL)) & (shouts * WORDS_A_MARK >= n_words)
    return unfinished | navigation | boilerplate | symbols | shouting


def repeat_words(by_window: F.Column) -> F.Column:
    """Words that lie in a window found twice or more. by_window: (h, w, i), hash, words and place of the windows, sorted;
    equal hashes alone do not count."""
    same = lambda x, i: F.coalesce((x["h"] == F.get(by_window, i)["h"]) & (x["w"] == F.get(by_window, i)["w"]), F.lit(False))
    at = F.filter(by_window, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most_lost: float = MOST_LOST) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines (with a word), n_failed_lines, lost_share, clean_text and kept.

    Lines are judged first and failing ones leave clean_text; a document goes (kept false) if it fails the base rules or
    if more than `most_lost` of its lines' characters went. A null or empty text has no words and fails the base rules;
    repeated rows stay repeated; a null id is kept; an empty table gives no rows. Output names win over equal names in
    docs; other columns are not read. Narrow: no shuffle. Windows of three words are compared by their words where their 64-bit hashes agree.
    """
    text = F.col("_text")
    step = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], text_or_empty(text_col).alias("_text"))
    judged = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.rlike(x, F.lit(WORD)).alias("worded")))
    step = step.withColumns({"_w": words(text), "_judged": F.transform(judged, lambda x: F.struct(x["line"].alias("line"), x["worded"].alias("worded"), (x["worded"] & line_fails(x["line"])).alias("fails")))})
    lines = lambda which: F.transform(F.filter("_judged", which), lambda x: x["line"])
    step = step.withColumns({
        "_n": F.size("_w").cast("long"),
        "_windows": F.when(F.size("_w") > 2, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
        "_lines": lines(lambda x: x["worded"]), "_kept": lines(lambda x: ~x["fails"]), "_good": lines(lambda x: x["worded"] & ~x["fails"]),
    })
    window = lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    step = step.withColumn("_by_window", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), window(i).alias("w"), i.alias("i"))))))
    step = step.withColumn("_repeat", F.when(F.col("_by_window").isNotNull(), repeat_words(F.col("_by_window"))).otherwise(0).cast("long"))
    chars = lambda lines: F.length(F.array_join(lines, ""))
    lost = 1 - F.try_divide(chars("_good"), chars("_lines"))
    failed = (F.col("_n") < 50) | (100 * F.col("_repeat") > 50 * F.col("_n"))
    return step.select(
        F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep if c != id_col],
        F.col("_n").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.col("_repeat").alias("n_repeat_words"), failed.alias("base_failed"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_good")).cast("long").alias("n_failed_lines"), F.coalesce(lost, F.lit(0.0)).alias("lost_share"),
        F.array_join("_kept", "\n").alias("clean_text"), (~failed & (F.coalesce(lost, F.lit(0.0)) <= most_lost)).alias("kept"),
    )


def oracle(most_lost: float = MOST_LOST) -> str:
    """DuckDB SQL of the columns that the query returns."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda pattern, of="l": f"len(regexp_extract_all({of}, {quote(pattern)}))"
    bare, ascii_space = "l", " || ".join(f"chr({c})" for c in (32, *range(9, 14)))
    for quoted in QUOTED:
        bare = f"regexp_replace({bare}, {quote(quoted)}, '\\1', 'g')"
    fails = f"""(NOT contains({quote(END_MARKS)}, right(rtrim(l, {ascii_space}), 1)) AND {count(WORD + "+")} < {LEAST_WORDS})
        OR ({count(SEPARATORS, bare)} >= {LEAST_SEPARATORS} AND {count(SEPARATORS, bare)} * {WORDS_A_MARK} >= {count(WORD + "+")})
        OR (length(l) < {BOILERPLATE_CHARS} AND regexp_matches(translate(l, '{UPPER}', '{LOWER}'), {quote(BOILERPLATE)}))
        OR {count(SYMBOLS)} * 10 > length(l)
        OR ({count("!")} >= 3 AND NOT regexp_matches(l, {quote(SMALL)}) AND {count("!")} * {WORDS_A_MARK} >= {count(WORD + "+")})"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, {quote(SPACE)}), lambda w: w <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {quote(WORD)})) AS ls FROM d),
g AS (SELECT *, list_filter(ls, lambda l: NOT ({fails})) AS good FROM w),
tri AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
tw AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM tri),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM tw) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY k),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, {quote(SYMBOLS)}))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(ls) - len(good))::BIGINT AS n_failed_lines,
        coalesce(1 - length(array_to_string(good, '')) / nullif(length(array_to_string(ls, '')), 0), 0) AS lost FROM g LEFT JOIN rep USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {most_lost}) AS kept FROM s"""
