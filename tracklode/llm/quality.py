"""Operator 8: line-first cleaning.

Each line meets the punctuation, symbol, navigation, boilerplate and
repetition rules below; failing lines go.  A document that fails the base
rules (too few words, or too many words in repeated 3-word windows), or that
loses more than half of its words with its lines, is rejected.

Texts of any length are read whole, line by line.  Words are runs of characters other than blank and TAB..CR.  Null text counts
as empty; an empty text has no words, so it is rejected.  Lines without words
count nowhere.  Repeated rows are judged alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_field, map_rows, struct

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: A line of prose ends in one of these.
LINE_ENDS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "”", "’", "»", "…", "。", "！", "？")
#: A line that is cut off is prose all the same if a sentence ends in it.
INNER_ENDS = (". ", "! ", "? ")
SEPARATORS = ("|", "»", "›", "•")
# Words of menus and phrases of notices in English, French, German and Spanish.
NAVIGATION_WORDS = frozenset(
    "home about contact login logout search menu next previous back top help sitemap share register subscribe "
    "accueil connexion recherche suivant retour aide partager inscription "
    "startseite kontakt anmelden abmelden suche menü weiter zurück hilfe impressum teilen "
    "inicio contacto buscar menú siguiente anterior volver ayuda compartir registrarse".split()
)
BOILERPLATE = (
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "mentions légales", "cliquez ici",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aceptar cookies", "aviso legal", "haga clic aquí",
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "lorem ipsum", "click here", "sign up for our")
MIN_WORDS = 50


def line_passes(line: str, words: list[bytes]) -> bool:
    """The rules that need only the line itself."""
    stripped = line.strip(BLANKS)
    if not stripped.endswith(LINE_ENDS) and not any(end in stripped for end in INNER_ENDS):
        return False
    n_symbols = sum(map(line.count, SYMBOLS))
    if n_symbols and 10 * n_symbols > sum(len(w.decode()) for w in words):
        return False
    if sum(map(line.count, SEPARATORS)) >= 2:
        return False
    low = stripped.lower()
    if len(words) <= 8 and all(w.strip(".,:;!?") in NAVIGATION_WORDS for w in low.split()):
        return False
    return not any(phrase in low for phrase in BOILERPLATE)


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    if len(codes) == n:
        return 0
    pair = ids[:-1] * len(codes) + ids[1:]
    if len(codes) > 1_000_000:  # keep the products below within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, cleaned text)."""
    text = text or ""
    words = text.encode().split()
    n_words = len(words)
    seen: set[str] = set()
    n_dup = kept_words = 0
    kept_lines = []
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        if line in seen:
            n_dup += 1
            continue
        seen.add(line)
        if line_passes(line, own):
            kept_words += len(own)
            kept_lines.append(line)
    n_repeat = repeated_window_words(words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
    kept = not base_failed and 2 * kept_words >= n_words
    return n_words, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), n_dup, n_repeat, base_failed, kept, kept_words, "\n".join(kept_lines)


MEASURES = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("kept_words", "bigint"))


def assess(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Measures and verdict of each row, with the cleaned text if asked for."""
    schema = T.StructType([id_field(docs, id_col), *struct(*MEASURES, *([("cleaned", "string")] if with_text else []))])

    def make():
        def f(cols):
            rows = list(zip(*map(judge, cols["__text"]), strict=True))
            return {id_col: cols[id_col]} | dict(zip(schema.names[1:], rows, strict=False))

        return f

    return map_rows(docs.select(id_col, F.col(text_col).alias("__text")), make, schema)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^ \t\n\v\f\r]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, word AS a, lead(word) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM p),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) x WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM g2) y GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
l1 AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth, regexp_extract_all(line, '[^ \t\n\v\f\r]+') AS ws FROM l0),
l2 AS (SELECT r, nth, len(ws) AS n,
    (regexp_matches(line, '[.!?:;,"'')\]”’»…。！？][ \t\v\f\r]*$') OR regexp_matches(regexp_replace(line, '^[ \t\v\f\r]+|[ \t\v\f\r]+$', '', 'g'), '[.!?] '))
    AND 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) <= length(regexp_replace(line, '[ \t\v\f\r]', '', 'g'))
    AND len(regexp_extract_all(line, '[|»›•]')) < 2
    AND NOT (len(ws) <= 8 AND len(list_filter(ws, lambda x: NOT list_contains({_sql_list(sorted(NAVIGATION_WORDS))}, trim(lower(x), '.,:;!?')))) = 0)
    AND len(list_filter({_sql_list(BOILERPLATE)}, lambda x: contains(lower(line), x))) = 0 AS ok
  FROM l1 WHERE len(ws) > 0),
l AS (SELECT r, count(*) FILTER (WHERE nth > 1) AS n_dup, coalesce(sum(n) FILTER (WHERE nth = 1 AND ok), 0) AS kept_words FROM l2 GROUP BY r),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\v\f\r]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(l.kept_words, 0)::BIGINT AS kept_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * kept_words >= n_words) AS kept, kept_words
FROM m
"""
