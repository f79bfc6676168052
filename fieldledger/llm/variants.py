"""Variant spellings of names, attributed through a noisy channel.

Every spelling is read into a form (see names.py) and forms are counted. A form is either a
canonical name or a misspelling, an abbreviation or a cut of a more frequent one: its posterior
for each candidate is the candidate's frequency times the likelihood of the change, against the
prior of being a name of its own. Each form goes to its maximum posterior; chains are joined to
groups by graph contraction.

Candidates are ranked by frequency. Forms are first taken together by (kind, part, consonants),
an equality, so the many misspelt vowels of a frequent name make no pairs. The leaders of these
blocks meet through positional segments (pigeonhole, k edits: k + 1 segments): first all against
the frequent ones, then what is left against each other. So a name with a third of all rows
meets each of its misspellings once, and they never meet one another.

Forms without a trade, and people known by an initial, then go to the most probable full form
with their head.

Trades and their short forms are learnt from the names themselves (learn_trades) and added to a given table.

Limits of reach: a pair whose names share no segment (three or more edits spread over a name; two over
a name without trade, with an initial or with an ambiguous short first name) and have unlike consonants is
no candidate; a form attached to a frequent one is no candidate for rarer forms; names of fewer than
MIN_HEAD letters are only linked when equal, for at that length one edit joins different names.
Nulls and stand-ins for a name are no spelling. Repeated rows add to the frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import block_join
from ..session import cut, free
from .components import connected_components
from .names import AMBIGUOUS, FILLER, LEGAL, NICKNAMES, TRADES, TRAILERS, is_stand_in, owner_form

EDITS = 2
FREQUENT = 1.5  # how many times the mean frequency of a leader makes a leader a candidate for all others
MIN_HEAD = 5
TYPO = 2.0  # cost of an edit in a name of eight letters or more, as a negative log-likelihood
SHORTENED = 2.0  # cost of vowels left out
NEW_NAME = 6.0  # how improbable a second name so close to another one is
TRADE_SHARE, SHARED = 0.002, 0.3
OTHER_LEGAL, NO_LEGAL = 2.0, 0.5


def segments(text: str, k: int = EDITS) -> Column:
    """array<struct(len, i, seg)>: the k + 1 positional segments of a reference string."""
    return F.expr(
        f"""transform(sequence(0, {k}), i -> struct(length({text}) AS len, i AS i,
              substring({text}, cast(floor(i * length({text}) / {k + 1}) AS int) + 1,
                        cast(floor((i + 1) * length({text}) / {k + 1}) - floor(i * length({text}) / {k + 1}) AS int)) AS seg))"""
    )


def probes(text: str, k: int = EDITS) -> Column:
    """array<struct(len, i, seg)>: the substrings of `text` where segments of a string within k edits can lie."""
    cut_at = lambda i: f"cast(floor({i} * len / {k + 1}) AS int)"
    return F.expr(
        f"""array_distinct(flatten(flatten(transform(sequence(greatest(length({text}) - {k}, 1), length({text}) + {k}), len ->
              transform(sequence(0, {k}), i -> transform(
                filter(sequence(-{k}, {k}), s -> s >= greatest(-i, length({text}) - len - ({k} - i)) AND s <= least(i, length({text}) - len + ({k} - i)) AND {cut_at('i')} + s >= 0),
                s -> struct(len AS len, i AS i, substring({text}, {cut_at('i')} + 1 + s, {cut_at('(i + 1)')} - {cut_at('i')}) AS seg)))))))"""
    )


def _near(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Pairs of rows of one block (`kind`, `part`) whose heads share a segment; left columns keep their names, right ones get c_."""
    keys = lambda arr: F.transform(arr, lambda s: F.xxhash64("kind", "part", s["len"], s["i"], s["seg"]))
    # a segment that very many names of a block hold is joined in slices
    pairs = block_join(left, right.withColumnRenamed("form", "c_form"), "form", "c_form", keys(probes("head", k)), keys(segments("head", k))).filter("form <> c_form").distinct()
    return pairs.join(left, "form").join(right.select(F.col("form").alias("c_form"), F.col("head").alias("c_head"), F.col("bones").alias("c_bones"), F.col("n").alias("c_n"), F.col("legal").alias("c_legal")), "c_form")


def _cost() -> Column:
    """Negative log-likelihood of writing `head` for `c_head`; null beyond reach."""
    d = F.levenshtein("head", "c_head")
    each = F.lit(TYPO) * F.greatest(F.lit(1.0), F.lit(8.0) / F.length("c_head"))
    bare = (F.col("bones") == F.col("c_bones")) & (F.length("bones") >= 4)
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (F.length("head") == F.length("c_head")) & (F.length("head") >= 9) & (d <= 4) & (letters("head") == letters("c_head"))
    reach = F.least(F.lit(3), F.floor(F.length("c_head") / 3).cast("int"))
    typo = F.when(d <= reach, each * d)
    return F.least(F.when(d == 0, F.lit(0.0)), F.when(bare, F.lit(SHORTENED)), F.when(swapped, each * 2), typo)


def _best(pairs: DataFrame, extra: Column | None = None) -> DataFrame:
    """Each form's candidate of maximum posterior, if it beats being a name of its own: (form, c_form, posterior)."""
    gain = F.log(F.col("c_n") + 0.5) - F.col("cost") - (extra if extra is not None else F.lit(0.0))
    own = F.log(F.col("n") + 0.5) - NEW_NAME
    scored = pairs.withColumn("cost", _cost()).filter("cost IS NOT NULL").withColumn("gain", F.bround(gain, 9)).withColumn("own", own)
    best = scored.groupBy("form").agg(F.max(F.struct("gain", "c_form")).alias("b"), F.max("own").alias("own"), F.sum(F.exp("gain")).alias("mass"))
    return best.filter("b.gain > own").select("form", F.col("b.c_form").alias("c_form"), (F.exp("b.gain") / (F.col("mass") + F.exp("own"))).alias("posterior"))


def learn_trades(spellings: DataFrame, column: str) -> dict[str, list[str]]:
    """Trades and their short forms as the names themselves show them: trade -> short forms.

    A trade is a last word (legal forms left out) that follows at least TRADE_SHARE of all first words; a word that
    begins like it and is spelled with its letters in order is a short form of the trade with which it shares the most
    first words, if it shares at least SHARED of its own. Only the table reaches the driver: trades are at most
    1 / TRADE_SHARE times the last words a first word has.
    """
    drop = [*LEGAL, *FILLER, "and", *NICKNAMES]
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}]+", " ")), " "), lambda w: ~w.isin(drop) & (F.length(w) > 1))
    said = spellings.select(words.alias("w")).filter("size(w) >= 2").select(F.col("w")[0].alias("head"), F.element_at("w", -1).alias("last"))
    said = cut(said.filter("length(head) >= 4").distinct())
    heads = said.select("head").distinct().count()
    by = said.groupBy("last").agg(F.count("*").alias("n"))
    trades = by.filter((F.col("n") >= heads * TRADE_SHARE) & (F.col("n") >= 3) & (F.length("last") >= 4)).select(F.col("last").alias("trade"), F.col("n").alias("t_n"))
    # letters in order: what is left of the trade once each letter of the word was found in turn
    in_order = F.expr("trade RLIKE concat('^', substring(last, 1, 1), '.*', array_join(split(substring(last, 2), ''), '.*'))")
    both = said.join(said.join(trades, F.col("last") == F.col("trade"), "left_semi").withColumnRenamed("last", "trade"), "head")
    short = both.filter(F.col("trade").startswith(F.substring("last", 1, 1)) & (F.length("last") < F.length("trade"))).groupBy("last", "trade").agg(F.count("*").alias("c"))
    short = short.join(by, "last").filter((F.col("c") >= F.col("n") * SHARED) & (F.col("c") >= 2)).filter(in_order)
    best = short.groupBy("last").agg(F.max_by("trade", F.struct("c", "trade")).alias("trade"))
    table = {r[0]: [] for r in trades.select("trade").collect()}
    for word, trade in sorted(map(tuple, best.collect())):
        # a word that is a short form is no trade of its own
        if trade in table:
            table[trade].append(word)
            table.pop(word, None)
    free(said)
    return table


def joined_trades(given: dict[str, list[str]], learnt: dict[str, list[str]]) -> dict[str, list[str]]:
    """The given table with the learnt trades and short forms that it lacks."""
    out = {t: list(ss) for t, ss in given.items()}
    known = {w for t, ss in given.items() for x in [t, *ss] for w in [x, *x.split()]}
    for t, ss in learnt.items():
        if t in out:
            out[t] += [s for s in ss if s not in known]
        elif t not in known and t not in TRAILERS:
            out[t] = [s for s in ss if s not in known]
    return out


def link_spellings(names: DataFrame, column: str, trades: dict[str, list[str]] = TRADES) -> DataFrame:
    """(spelling, n, group_id, canonical) of each distinct usable spelling in `column`; canonical is the most frequent one of its group.

    `trades`: a table of trades and their short forms, which may be empty; those learnt from the spellings are added.
    """
    counted = names.select(F.col(column).alias("spelling")).filter(F.col("spelling").isNotNull() & ~is_stand_in("spelling")).groupBy("spelling").agg(F.count("*").alias("n"))
    counted = cut(counted)
    trades = joined_trades(trades, learn_trades(counted, "spelling"))
    parsed = counted.withColumn("f", owner_form(trades)("spelling")).select("spelling", "n", "f.*").filter("head <> ''")
    form_key = F.concat_ws("|", "kind", "head", "part", F.when(F.col("part") == "", F.col("legal")).otherwise(F.lit("")))
    parsed = cut(parsed.withColumn("form", form_key))
    free(counted)
    # one row a form; its legal form is the most frequent one said with it
    by_legal = parsed.groupBy("form", "kind", "head", "part", "bones", "legal").agg(F.sum("n").alias("n"))
    forms = by_legal.groupBy("form", "kind", "head", "part", "bones").agg(
        F.sum("n").alias("n"), F.max_by("legal", F.struct(F.when(F.col("legal") == "", 0).otherwise(F.col("n")), F.col("legal"))).alias("legal")
    )
    forms = cut(forms)
    long = forms.filter(F.length("head") >= MIN_HEAD)

    # blocks of equal consonants: all go to their most frequent form
    lead = long.groupBy("kind", "part", "bones").agg(F.max_by(F.struct("form", "head", "legal"), F.struct("n", "form")).alias("l"), F.sum("n").alias("n"))
    lead = cut(lead.select(F.col("l.form").alias("form"), F.col("l.head").alias("head"), F.col("l.legal").alias("legal"), "kind", "part", "bones", "n"))
    leader = lead.select("kind", "part", "bones", F.col("form").alias("c_form"), F.col("head").alias("c_head"), F.col("n").alias("c_n"))
    follow = long.filter(F.length("bones") >= 3).join(leader, ["kind", "part", "bones"]).filter("form <> c_form").withColumn("c_bones", F.col("bones"))
    links = follow.withColumn("cost", _cost()).filter("cost IS NOT NULL").select("form", "c_form")

    # leaders by segments: against the frequent ones, then the rest among themselves
    said = lead.filter("part <> ''")
    above = "c_n > n OR (c_n = n AND c_form > form)"
    often = F.col("n") >= FREQUENT * (said.agg(F.avg("n")).first()[0] or 0.0)
    first = cut(_best(_near(said, said.filter(often), EDITS).filter(above)))
    rest = said.filter(~often).join(first.select("form"), "form", "left_anti")
    second = _best(_near(rest, rest, EDITS).filter(above))
    links = links.unionByName(first.select("form", "c_form")).unionByName(second.select("form", "c_form"))

    # no trade said: to the full form of that head; of several, by legal form and frequency
    full = lead.filter("kind = 'o' AND part <> ''").withColumn("part", F.lit(""))
    bare = long.filter("kind = 'o' AND part = ''")
    legal = F.when(F.col("legal") == "", F.lit(NO_LEGAL)).when(F.col("legal") == F.col("c_legal"), F.lit(0.0)).otherwise(F.lit(OTHER_LEGAL))
    unsaid = cut(_best(_near(bare, full, 1), legal))
    bare_lead = lead.filter("kind = 'o' AND part = ''").join(unsaid.select("form"), "form", "left_anti")
    alone = _best(_near(bare_lead, bare_lead, 1).filter(above))
    same_head = bare.join(unsaid.select("form"), "form", "left_anti").groupBy("head").agg(F.max_by("form", F.struct("n", "form")).alias("c_form"))
    twins = bare.join(unsaid.select("form"), "form", "left_anti").join(same_head, "head").filter("form <> c_form").select("form", "c_form")
    # an initial: to the full name of that family which begins with it
    person = lead.filter("kind = 'p' AND length(part) > 1").withColumn("part", F.substring("part", 1, 1))
    initial = long.filter("kind = 'p' AND length(part) = 1")
    initials = _best(_near(initial, person, 1))
    # a short name of several names: to the full name of that family it may stand for
    stands = F.create_map(*[x for k, v in AMBIGUOUS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    short = long.filter(F.col("part").isin(*AMBIGUOUS)).withColumn("part", F.explode(F.try_element_at(stands, F.col("part"))))
    shorts = _best(_near(short, lead.filter("kind = 'p' AND length(part) > 1"), 1))
    links = links.unionByName(unsaid.select("form", "c_form")).unionByName(alone.select("form", "c_form")).unionByName(twins).unionByName(initials.select("form", "c_form")).unionByName(shorts.select("form", "c_form"))

    groups = connected_components(cut(links.distinct()), "form", "c_form").select(F.col("id").alias("form"), F.col("group_id"))
    grouped = cut(parsed.join(groups, "form", "left").select("spelling", "n", F.coalesce("group_id", "form").alias("group_id")))
    canonical = grouped.groupBy("group_id").agg(F.max_by("spelling", F.struct("n", "spelling")).alias("canonical"))
    return grouped.join(canonical, "group_id").select("spelling", "n", "group_id", "canonical")
