"""Per-document text statistics, and the text type they point to.

`line_groups` reads every line of every text once, inside the JVM. Each line is measured, and eleven
labelling functions, each a threshold or two on one statistic (share of common words, ending,
beginning, cells, length, symbols and so on), give it a level; most levels only lean towards a
type, and the lowest is no opinion. The levels of all functions are one number, the pattern. Lines
are summed by document and pattern before the shuffle, so a text of a million lines costs a few rows.

No function names a line's type. `fit_types` learns by expectation-maximisation, from the counted
patterns of the whole corpus, how often each level occurs in each shape of line (several shapes a
type: marked items, labels, cells, page furniture, running text) and so how far each function can be
trusted; the posterior of a line's pattern is its type. A document's types are those of its
characters: it is prose if more than half of it is, else the greatest of the other three. Only
counts of patterns reach the driver, of which there are at most the product of the levels.

Null and blank texts have no lines: their statistics are zero and their type is junk. Rows with a
null doc_id are left out. Repeated rows of one doc_id are summed as one text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["prose", "list", "table", "junk"]
MAX_COMMON = 10_000  # longer lists of common words are refused

# fixed values: shapes of lines
MARKER = r"^\s*(?:[-*•+–—·▪‣>o]|->|--|=>|\[[ xX]?\]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|[Nn]o\. ?[0-9]+:?)\s+\S"
LEADER = r"(?:\.{3,}|\s(?:\. ){3,})\s*[0-9]+\s*$"
LABELLED = r"^\s*[^:=.!?;,]{1,30}(?::| =)\s+\S.{0,80}$"
HEXDUMP = r"^\s*[0-9a-fA-F]{6,8}:?\s+(?:[0-9a-fA-F]{2,4}\s){3,}"
LOGGED = r"\[(?:DBG|DEBUG|INFO|WARN|ERR|ERROR|TRACE)\]|0x[0-9a-fA-F]{3,}|\b[a-z]{1,4}=[0-9]+;[a-z]{1,4}=[0-9]+"
MARKUP = r"^\s*(?:</?[A-Za-z][^>]*>\s*)+$|</?(?:div|span|script|style|td|tr|a|p|li|ul|nav)\b[^>]*>"
PAGE = (
    r"(?i)^\s*(?:home( \| |$)|skip to |cookie|sign (?:in|up|out)|log ?in|back to top|share \||>> ?next|<< ?prev|menu\s*$|search\.*\s*$|\[image\]|you are here|"
    r"(?:\(c\)|©|copyright).{0,40}|all rights reserved|privacy|terms of|subscribe|contact us|read more|print\s*$|next\s*$|previous\s*$|page [0-9]+ of|loading\.*\s*$)"
)
ENCODED = r"(?:^|\s)[A-Za-z0-9+/=_-]{36,}(?:\s|$)"
GARBLED = r"Ã.|â€.?|Â.|�|ï¿½|Å.|Ð.|Ñ\u0080"
SPECKS = r"^[lIi1|!'`´~_.,\-\s]*[lIi1|!'`´~,][lIi1|!'`´~_.,\-\s]*$"
NUMBER = r"^[-+]?[0-9][0-9.,]*%?$"
KNOT = r"[bcdfghjklmnpqrstvwxz]{4,}|(?<!\p{L})[bcdfghjklmnpqrstvwxz]{3,}(?!\p{L})|q(?!u)"

# the labelling functions and the levels of each: its name for level 1, 2, ...; 0 is no opinion
FUNCTIONS = {
    "common": ["many", "some", "hardly"],  # share of common words: 0.22 and up, 0.08 and up, less; no opinion on one or two words
    "ending": ["sentence", "stop"],  # . ! or ? after several words, or after one
    "start": ["marker", "label"],  # a bullet, number or dot leader; `label: value`
    "cells": ["ruled", "tight", "aligned", "gap"],  # tabs or pipes; ; or , without space; two wide gaps or more; one
    "length": ["few", "short", "line", "long"],  # words: 1-3, 4-7, 8-14, 15 and up; no opinion without words
    "machine": ["code", "page"],  # dumps, logs, markup, encoded bytes; navigation of pages
    "broken": ["broken"],  # spaced letters, wrong encodings, specks, tag runs, unpronounceable words
    "symbols": ["numbers", "signs", "figures"],  # nothing but numbers; letters and digits under half, without pipes; letters under half
    "repeats": ["repeats"],  # each word five times or more
    "inline": ["series"],  # separators every five words or fewer
    "alone": ["lonely", "only"],  # the text's one line: at most three words, short or repeated; any other
}
SIZES = {f: len(levels) + 1 for f, levels in FUNCTIONS.items()}
MAX_PATTERNS = math.prod(SIZES.values())

# where learning starts: shapes of line of each type, with the probable levels of each; what a shape doesn't name is as in USUAL
USUAL = {"machine": {0: 0.98}, "broken": {0: 0.99}, "symbols": {0: 0.97}, "repeats": {0: 0.99}, "inline": {0: 0.95}, "alone": {0: 0.98}, "cells": {0: 0.95}, "start": {0: 0.95}}
CELLS = {"common": {0: 0.45, 3: 0.45}, "ending": {0: 0.95}, "start": {0: 0.85}, "length": {0: 0.15, 1: 0.3, 2: 0.3, 3: 0.2}, "symbols": {0: 0.6, 1: 0.1, 2: 0.1, 3: 0.2}}
SHAPES = [
    ("prose", {"common": {1: 0.9, 2: 0.08}, "ending": {0: 0.29, 1: 0.7}, "length": {3: 0.25, 4: 0.6}}),
    ("prose", {"common": {0: 0.2, 1: 0.4, 2: 0.3}, "ending": {1: 0.9}, "length": {1: 0.1, 2: 0.6, 3: 0.2}, "alone": {0: 0.6, 2: 0.39}}),
    ("list", {"common": {0: 0.3, 2: 0.3, 3: 0.3}, "ending": {0: 0.9}, "start": {1: 0.9, 2: 0.05}, "length": {1: 0.25, 2: 0.5, 3: 0.2}}),
    ("list", {"common": {0: 0.35, 2: 0.3, 3: 0.3}, "ending": {0: 0.97}, "start": {1: 0.05, 2: 0.9}, "length": {1: 0.25, 2: 0.5, 3: 0.2}}),
    ("list", {"common": {0: 0.45, 3: 0.45}, "ending": {0: 0.95}, "length": {1: 0.5, 2: 0.4}}),
    ("list", {"common": {2: 0.3, 3: 0.6}, "ending": {0: 0.8}, "length": {3: 0.3, 4: 0.6}, "inline": {1: 0.95}}),
    ("table", CELLS | {"cells": {1: 0.95}}),
    ("table", CELLS | {"cells": {2: 0.95}}),
    ("table", CELLS | {"cells": {3: 0.6, 4: 0.35}}),
    ("junk", {"machine": {1: 0.97}, "cells": {0: 0.8}, "symbols": {0: 0.5}}),
    ("junk", {"machine": {2: 0.97}, "length": {1: 0.6, 2: 0.3}, "cells": {0: 0.8}}),
    ("junk", {"broken": {1: 0.97}, "cells": {0: 0.8}, "symbols": {0: 0.5}, "common": {3: 0.7}}),
    ("junk", {"symbols": {2: 0.95}, "cells": {0: 0.9}, "length": {0: 0.6, 1: 0.2}}),
    ("junk", {"repeats": {1: 0.97}, "cells": {0: 0.9}}),
    ("junk", {"common": {3: 0.97}, "length": {3: 0.35, 4: 0.6}}),
    ("junk", {"alone": {1: 0.97}, "length": {1: 0.9}}),
]
TRUST = 0.5  # share of what is learnt in each shape's levels, against where it started; the same at every size of corpus
SUMS = ["chars", "letters", "digits", "words", "common", "forms", "ended", "marked", "lines"]


def _common(words: DataFrame) -> list[str]:
    rows = words.filter("word IS NOT NULL").select(F.lower(F.trim("word")).alias("w")).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return sorted(r[0] for r in rows)


def _digits(s):
    return F.length(s) - F.length(F.translate(s, "0123456789", ""))


def _measured(docs: DataFrame, common: list[str]) -> DataFrame:
    """(doc_id, s, only, and the statistics) of each line that is not blank; a blank text keeps one empty line."""
    body = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n\f\x0b"))
    body = F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))  # a split at one sign needs no regular expression
    # in two steps: what stands beside an explode is worked out again for every line
    split = docs.filter("doc_id IS NOT NULL").select("doc_id", F.split(body, "\n").alias("split"))
    lines = split.select("doc_id", (F.size("split") == 1).alias("only"), "split").select("doc_id", "only", F.explode("split").alias("line"))
    s = F.col("s")
    # how often a sign stands in the line: by what is left without it
    without = lambda c, *signs: without(F.replace(c, F.lit(signs[0]), F.lit("")), *signs[1:]) if signs else c
    signs = lambda c: F.expr(f"(length(s) - length(replace(s, '{c}', ''))) div {len(c)}").cast("int")
    has = lambda c: F.instr(s, c) > 0
    # an expensive pattern is tried only where a cheap test lets it match
    tried = lambda test, value: F.when(test, value).otherwise(F.lit(0))
    count = lambda p, c=s: F.regexp_count(c, F.lit(p))
    return (
        lines.select("doc_id", "only", F.rtrim("line").alias("s"))
        .withColumn("chars", F.length(without(s, " ", "\t", "\f", "\x0b")))
        .filter((F.col("chars") > 0) | F.col("only"))
        .withColumn("tokens", F.regexp_extract_all(F.lower("s"), F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), 0))
        .withColumn("letters", F.length(without(F.array_join("tokens", ""), "'", "’", "-")))
        .withColumn("words", F.size("tokens"))
        .withColumn("common", F.size(F.filter("tokens", lambda t: t.isin(common))))
        .withColumn("forms", F.size(F.array_distinct("tokens")))
        .withColumn("digits", _digits(s))
        .withColumn("tabbed", F.instr(F.trim(s), "\t") > 0)
        .withColumn("pipes", signs("|"))
        .withColumn("gaps", tried(has("  "), count(r"\S {2,}(?=\S)", F.trim(s))))
        .withColumn("semis", tried(has(";"), signs(";") - signs("; ")))
        .withColumn("commas", tried(has(","), signs(",") - signs(", ")))
        .withColumn("stops", signs(", ") + signs("; ") + signs(" / ") + signs(" · ") + signs(" • ") + (F.endswith(s, F.lit(",")) | F.endswith(s, F.lit(";"))).cast("int"))
        .withColumn("singles", tried((F.col("words") >= 8) & (F.col("letters") < F.col("words") * 2), count(r"(?<!\S)\p{L}(?!\S)")))
        .withColumn("garbled", tried(F.octet_length("s") > F.length("s"), count(GARBLED)))
        .withColumn("tags", tried(has("#"), count(r"(?<!\S)#\p{L}")))
        .withColumn("knots", tried((F.col("words") >= 6) & (F.col("common") * 10 < F.col("words")), count(KNOT, F.lower(s))))
        .withColumn("leader", (has("...") | has(". . ")) & s.rlike(LEADER))
        .withColumn("marker", s.rlike(MARKER))
        .withColumn("labelled", (has(":") | has(" = ")) & s.rlike(LABELLED))
        .withColumn("ends", ~F.col("leader") & F.substring(F.translate(F.substring(s, -4, 4), "\"'”’)]", ""), -1, 1).isin(".", "!", "?", "…"))
        .drop("tokens")
    )


def _levels(m: DataFrame) -> dict:
    """The level each labelling function gives to a measured line."""
    s, words, letters, chars = F.col("s"), F.col("words"), F.col("letters"), F.col("chars")
    n = F.greatest(words, F.lit(1))
    share = F.col("common") / n
    has = lambda c: F.instr(s, c) > 0
    step = lambda *tests: F.coalesce(*[F.when(t, v) for t, v in tests], F.lit(0))
    code = (
        s.rlike(HEXDUMP) | ((has("[") | has("0x") | has("=")) & s.rlike(LOGGED)) | (has("<") & s.rlike(MARKUP))
        | ((F.length(s) >= 36) & (words < 40) & s.rlike(ENCODED))
    )
    broken = (
        s.rlike(SPECKS) | ((F.col("singles") >= 8) & (F.col("singles") * 2 > letters)) | ((F.col("garbled") >= 2) & (F.col("garbled") * 14 > chars))
        | ((F.col("tags") >= 3) & (F.col("tags") * 2 > n)) | ((words >= 6) & (F.col("knots") * 5 >= words)) | (F.col("gaps") > 20)
    )
    ruled = s.rlike(r"^[\s|+:=-]+$") & (chars >= 3) & has("|")
    solid = chars - F.col("pipes")  # signs between cells say nothing about what is in them
    plain_numbers = (letters == 0) & F.expr(f"forall(filter(split(trim(s), ' +'), t -> t <> ''), t -> t rlike '{NUMBER}')")
    lonely = F.col("only") & (words <= 3) & ((F.col("forms") <= 1) | (letters < n * 4.5))
    return {
        "common": step((words < 3, 0), ((share >= 0.22) & (words >= 6) | (share >= 0.3), 1), (share >= 0.08, 2), (F.lit(True), 3)),
        "ending": step((F.col("ends") & (words >= 2), 1), (F.col("ends"), 2)),
        "start": step((F.col("marker") & (letters > 2) | F.col("leader"), 1), (F.col("labelled") & (letters > 1), 2)),
        "cells": step((F.col("tabbed") | (F.col("pipes") >= 2) | ruled, 1), ((F.col("semis") >= 2) | (F.col("commas") >= 2), 2), (F.col("gaps") >= 2, 3), (F.col("gaps") >= 1, 4)),
        "length": step((words == 0, 0), (words <= 3, 1), (words <= 7, 2), (words <= 14, 3), (F.lit(True), 4)),
        "machine": step((code, 1), ((words <= 12) & s.rlike(PAGE), 2)),
        "broken": step((broken, 1)),
        "symbols": step((plain_numbers, 1), (ruled, 0), ((letters * 2 < solid) & ((letters + _digits(s)) * 2 < solid), 2), (letters * 2 < solid, 3)),
        "repeats": step(((words >= 5) & (F.col("forms") * 5 <= words), 1)),
        "inline": step(((F.col("stops") >= 2) & (words <= 5 * (F.col("stops") + 1)), 1)),
        "alone": step((lonely, 1), (F.col("only"), 2)),
    }


def line_groups(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, pattern, and the sums of SUMS): the lines of each text taken together by the levels they got; pattern is -1 for a blank text."""
    m = _measured(docs, _common(common_words))
    levels = _levels(m)
    pattern = F.lit(0)
    for f, size in SIZES.items():
        pattern = pattern * size + levels[f]
    seen = F.col("chars") > 0
    marked = F.col("marker") | F.col("leader") | F.col("labelled")
    typed = m.withColumn("pattern", F.when(seen, pattern).otherwise(-1).cast("int"))
    typed = typed.withColumn("ended", (F.col("ends") & seen).cast("int")).withColumn("marked", (marked & seen).cast("int")).withColumn("lines", seen.cast("int"))
    return typed.groupBy("doc_id", "pattern").agg(*[F.sum(c).alias(c) for c in SUMS])


def text_statistics(groups: DataFrame) -> DataFrame:
    """One row a doc_id: words, lines, mean_word_length, symbol_ratio, digit_ratio, punctuated_lines (share of lines ending in . ! ?), marked_lines, common_share, distinct_share."""
    sums = groups.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    d = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return sums.select(
        "doc_id", "chars", "words", "lines", d("letters", "words").alias("mean_word_length"),
        ((F.col("chars") - F.col("letters") - F.col("digits")) / F.greatest(F.col("chars"), F.lit(1))).alias("symbol_ratio"), d("digits", "chars").alias("digit_ratio"),
        d("ended", "lines").alias("punctuated_lines"), d("marked", "lines").alias("marked_lines"), d("common", "words").alias("common_share"), d("forms", "words").alias("distinct_share"),
    )


def levels_of(patterns: np.ndarray) -> np.ndarray:
    """The levels (patterns x functions) that pattern numbers stand for."""
    out, rest = [], np.asarray(patterns, dtype=np.int64)
    for size in reversed(SIZES.values()):
        out.append(rest % size)
        rest = rest // size
    return np.stack(out[::-1], 1)


def _start() -> dict[str, np.ndarray]:
    """Function -> (shapes x levels), what is not named sharing what is left."""
    out = {}
    for f, size in SIZES.items():
        rows = []
        for _, told in SHAPES:
            said = (USUAL | told).get(f, {})
            free = [x for x in range(size) if x not in said]
            row = np.array([said.get(x, (1 - sum(said.values())) / max(len(free), 1)) for x in range(size)])
            rows.append(np.clip(row, 1e-4, None) / np.clip(row, 1e-4, None).sum())
        out[f] = np.array(rows)
    return out


def fit_types(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior (patterns x kinds) by expectation-maximisation over counted patterns, and each function's learnt (kinds x levels).

    A shape keeps a fixed share of its start (1 - TRUST), which holds it to its type however common other shapes are.
    """
    x, counts, start = levels_of(patterns), np.asarray(counts, dtype=float), _start()
    theta, prior, post = dict(start), np.full(len(SHAPES), 1 / len(SHAPES)), None
    for _ in range(rounds):
        ll = np.log(prior) + sum(np.log(theta[f])[:, x[:, j]].T for j, f in enumerate(SIZES))
        fresh = np.exp(ll - ll.max(1, keepdims=True))
        fresh /= fresh.sum(1, keepdims=True)
        if post is not None and np.abs(fresh - post).max() < 1e-4:
            break
        post = fresh
        w = post * counts[:, None]
        prior = (w.sum(0) + 1) / (w.sum() + len(SHAPES))
        for j, f in enumerate(SIZES):
            seen = np.stack([np.bincount(x[:, j], weights=w[:, c], minlength=SIZES[f]) for c in range(len(SHAPES))]) + 1e-9
            theta[f] = TRUST * seen / seen.sum(1, keepdims=True) + (1 - TRUST) * start[f]
    member = np.array([[k == kind for k in KINDS] for kind, _ in SHAPES], dtype=float)
    share = prior @ member
    learnt = {f: (member * prior[:, None]).T @ theta[f] / share[:, None] for f in SIZES}
    return post @ member, learnt | {"prior": share}


def counted_patterns(groups: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The patterns that occur (at most MAX_PATTERNS, by construction) and their lines."""
    rows = groups.filter("pattern >= 0").groupBy("pattern").agg(F.sum("lines").alias("n")).collect()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float)


def text_types(groups: DataFrame) -> DataFrame:
    """doc_id, kind, confidence, and p_prose ... p_junk, the expected share of each type in the text, from line_groups."""
    patterns, counts = counted_patterns(groups)
    post = fit_types(patterns, counts)[0] if len(patterns) else np.zeros((0, len(KINDS)))
    data = [(int(p), *map(float, q)) for p, q in zip(patterns, post)] + [(-1, 0.0, 0.0, 0.0, 1.0)]
    # at most MAX_PATTERNS + 1 rows, a few MB
    known = F.broadcast(groups.sparkSession.createDataFrame(data, "pattern int, " + ", ".join(f"{k} double" for k in KINDS)))
    weight = F.greatest(F.col("chars"), F.lit(1))
    by = groups.join(known, "pattern").groupBy("doc_id").agg(*[(F.sum(F.col(k) * weight) / F.sum(weight)).alias(f"p_{k}") for k in KINDS])
    best = F.greatest(*[f"p_{k}" for k in KINDS[1:]])
    kind = F.when(F.col("p_prose") > 0.5, "prose").otherwise(F.coalesce(*[F.when(F.col(f"p_{k}") == best, k) for k in KINDS[1:]]))
    return by.select("doc_id", kind.alias("kind"), F.when(F.col("p_prose") > 0.5, F.col("p_prose")).otherwise(best).alias("confidence"), *[f"p_{k}" for k in KINDS])
