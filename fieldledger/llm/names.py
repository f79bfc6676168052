"""Typed names of organisations, people and sites taken apart.

`parse_owner` reads one spelling into a form: an organisation is (head, trade, legal form), a
person is (family name, first name or initial). Word order, case, spacing, punctuation, legal
forms, titles, nicknames and usual short forms of trades are taken out here; typing errors are
left to the comparison of forms.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY = 1 << 16  # words a worker remembers the reading of; they repeat far more often than whole names

# fixed values: words that stand in for a name
STAND_INS = [
    "n/a", "na", "tbd", "tba", "null", "nil", "none", "none listed", "not listed", "not reported", "not available", "not applicable", "not known",
    "unknown", "unk", "same", "same as above", "see parent", "see above", "see note", "various", "pending", "no name", "missing", "private", "owner", "self",
]
# fixed values: legal forms
LEGAL = {
    "inc": "inc", "incorporated": "inc", "llc": "llc", "lp": "lp", "company": "co", "co": "co", "cmpny": "co", "cmp": "co", "coy": "co", "corp": "corp", "corporation": "corp", "corpn": "corp",
    "limited": "ltd", "ltd": "ltd", "lmtd": "ltd", "partnership": "lp", "plc": "plc", "llp": "llp",
}
FILLER = {"the", "grp", "gpr", "group", "mr/ms", "mr", "ms", "mrs", "dr"}
# fixed values: trades and their usual short forms
TRADES = {
    "aggregates": ["aggs", "agg"], "asphalt": ["asph"], "brewing": ["brwg"], "brothers": ["bros"], "castings": ["cstgs", "cast"], "chemical": ["chem", "chems"], "coatings": ["ctgs", "coat"],
    "cold storage": ["cold stg", "cold stor", "cold"], "concrete": ["conc"], "controls": ["ctrls", "ctls"], "dairy": ["dry", "dair"], "distilling": ["distg", "dist"], "energy": ["enrgy", "ener"],
    "engineering": ["engrg", "engg", "engi", "eng"], "fabrication": ["fab", "fabr"], "feed": ["fd"], "fertilizer": ["fert"], "foods": ["fds", "food"], "glass": ["gls", "glas"], "industries": ["inds", "indu", "ind"],
    "instruments": ["instr", "inst"], "international": ["intl", "inte"], "laboratories": ["labs", "labo"], "logistics": ["logist", "logi"], "manufacturing": ["mfg", "manu"], "metals": ["mtls", "meta"],
    "packaging": ["pkg", "pack"], "paper": ["ppr", "pape"], "pharma": ["phrm", "phar"], "polymers": ["polym", "poly"], "poultry": ["pltry", "poul"], "process equipment": ["proc equip", "proc eqpt", "proc"],
    "refining": ["refg", "refi"], "rubber": ["rbr", "rubb"], "services": ["svcs", "serv", "svc"], "systems supply": ["sys sup", "sys supp", "syst"], "technologies": ["tech", "techs"], "textiles": ["txtl", "txtls", "text"],
    "timber": ["tmbr", "timb"], "valve and pump": ["valve pump", "vlv and pmp", "valve and pmp", "vlv pmp", "valve n pump", "valve n pmp", "valv", "vlv"], "water products": ["wtr prod", "wtr prods", "wate"], "wire": ["wr"],
}
# fixed values: first names and their short forms
NICKNAMES = {
    "alexander": "alex sandy al alec xander lex", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benj", "catherine": "cathy cath", "charles": "chuck charlie chas charley", "christopher": "chris",
    "daniel": "dan danny", "david": "dave", "deborah": "deb debbie debby debra", "donald": "don", "dorothy": "dot dottie", "edward": "ed eddie ned edw", "elizabeth": "liz beth betty eliz lizzie betsy eliza", "frederick": "fred",
    "george": "geo", "gregory": "greg", "henry": "hank harry", "james": "jim jas jimmy jamie", "jennifer": "jen jenny", "john": "jack jno", "jonathan": "jon", "joseph": "joe jos joey", "katherine": "kate kathy kath katie kathie kay",
    "kenneth": "ken kenny", "lawrence": "larry", "margaret": "maggie peggy meg marge peg margie", "matthew": "matt", "michael": "mike mick", "nancy": "nan", "nicholas": "nick", "pamela": "pam", "patricia": "pat trish patty tricia patsy",
    "patrick": "paddy", "philip": "phil", "raymond": "ray", "rebecca": "becky", "richard": "dick rick rich richd ricky", "robert": "bob rob bobby robt robbie bert", "ronald": "ron", "samuel": "sam saml sammy", "sandra": "",
    "stephen": "steve", "susan": "sue susie suzy susy", "theodore": "teddy theo", "thomas": "tom thos tommy", "timothy": "tim", "victoria": "vicky", "virginia": "ginny", "walter": "walt", "william": "bill will wm billy willie liam",
}
AMBIGUOUS = {"ted": ["edward", "theodore"]}  # short for more than one name
FIRST = {n: k for k, v in NICKNAMES.items() for n in [k, *v.split()]} | {n: n for n in AMBIGUOUS}
TRAILERS = {"sons", "farms", "farm", "trucking", "sawmill", "daughters", "son"}

FULL = [k for k in NICKNAMES if len(k) >= 5]
DIGITS = str.maketrans({"0": "o", "1": "l", "5": "s", "3": "e", "4": "a", "8": "b", "@": "a", "$": "s"})


JOINED, DOTTED_LLC, DOTTED_LP = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])"), re.compile(r"\bl\.\s?l\.\s?c\b\.?"), re.compile(r"\bl\.\s?p\b\.?")
WORD, DIGIT, LETTER, QUOTES = re.compile(r"[^\W_]+"), re.compile(r"\d"), re.compile(r"[a-z]"), str.maketrans("", "", "’'`")


def is_stand_in(c: str) -> Column:
    """Blank, without any letter, or a stand-in word."""
    return F.expr(f"trim({c}) NOT RLIKE '[A-Za-z]'") | F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).isin(STAND_INS)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            cost = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                cost = min(cost, before[j - 1] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _squeeze(s: str) -> str:
    return "".join(s.split())


class Vocabulary:
    """The trades a reading of names knows, with their usual short forms: trade -> short forms."""

    def __init__(self, trades: dict[str, list[str]]):
        self.trades = trades
        self.short = {s: t for t, ss in trades.items() for s in ss} | {t: t for t in trades} | {t.replace(" ", ""): t for t in trades}
        long = {(t.replace(" ", ""), t) for t in trades} | {(s.replace(" ", ""), t) for s, t in self.short.items() if s.count(" ") and len(s) > 8}
        self.by_length = sorted(long, key=lambda x: (-len(x[0]), x))
        self.words = {w for t in trades for w in t.split()}
        self.first_name = functools.lru_cache(MEMORY)(self._first_name)
        self._trade = functools.lru_cache(MEMORY)(self._trade_of)

    def _first_name(self, word: str) -> str | None:
        if word in self.words:
            return None
        if word in FIRST:
            return FIRST[word]
        if len(word) >= 4:
            for full in FULL:
                if word[0] == full[0] and abs(len(word) - len(full)) <= 1 and edits(word, full, 1) <= 1:
                    return full
        return None

    def trade_of(self, words: list[str]) -> tuple[str | None, int]:
        """The trade that the last words name, and how many words it takes."""
        return self._trade(tuple(words[-4:]))

    def _trade_of(self, words: tuple[str, ...]) -> tuple[str | None, int]:
        for take in (3, 2, 1):
            if len(words) >= take:
                said = " ".join(words[-take:])
                if said in self.short:
                    return self.short[said], take
        for take in (3, 2, 1):
            if len(words) > take or (len(words) == take and take > 1):
                said = _squeeze("".join(words[-take:]))
                near = []
                for flat, t in self.by_length if len(said) >= 4 else ():
                    limit = 1 if len(flat) < 7 else 2
                    if (take == 1 or " " in t) and abs(len(said) - len(flat)) <= limit and (far := edits(said, flat, limit)) <= limit:
                        near.append((far, t))
                if near:
                    return min(near)[1], take
        # two words, each cut short or misspelt
        if len(words) >= 3:
            for t in self.trades:
                parts = [p for p in t.split() if p != "and"]
                if len(parts) == 2 and all(w[0] == p[0] and _subsequence(w, p) for w, p in zip(words[-2:], parts)):
                    return t, 2
        if len(words) >= 2 and 3 <= len(words[-1]) <= 7:
            w = words[-1]
            fits = [t for t in self.trades if t[0] == w[0] and (t.startswith(w) or (_subsequence(w, t) and _bones(w) == _bones(t)[: len(_bones(w))] and len(_bones(w)) >= 3))]
            if len(fits) == 1:
                return fits[0], 1
        return None, 0


@functools.lru_cache(4)
def vocabulary(trades: tuple[tuple[str, tuple[str, ...]], ...] | None = None) -> Vocabulary:
    """The vocabulary of a table of trades as nested tuples, by default TRADES; built once a worker."""
    return Vocabulary(TRADES if trades is None else {t: list(ss) for t, ss in trades})


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def _bones(s: str) -> str:
    return re.sub("[aeiouy]", "", s)


def bones(head: str) -> str:
    """Consonants of a name after folding letters often taken for one another."""
    return re.sub("[aeiou]", "", head).replace("rn", "m")


@functools.lru_cache(MEMORY)
def _near_legal(w: str) -> str:
    """The legal form that a word misspells, or ''."""
    near = [f for k, f in LEGAL.items() if len(k) >= 6 and edits(w, k, 2) <= (2 if len(k) >= 9 else 1)]
    return near[0] if near else "llc" if len(w) == 3 and edits(w, "llc", 1) <= 1 else ""


@functools.lru_cache(MEMORY)
def _near_trailer(w: str) -> bool:
    return len(w) >= 4 and any(len(t) >= 4 and edits(w, t, 1) <= 1 for t in TRAILERS)


def _legal(words: list[str], v: Vocabulary) -> tuple[list[str], str]:
    """Words without the legal form at their end, and the form."""
    form = ""
    while len(words) > 1:
        w = words[-1]
        if w in LEGAL:
            form = form or LEGAL[w]
            words = words[:-1]
        elif w in FILLER and len(words) > 2:
            words = words[:-1]
        elif form == "lp" and w == "ltd" or w in ("limited", "ltd") and form == "lp":
            words = words[:-1]
        else:
            break
    if len(words) > 1 and not form:
        w = words[-1]
        near = _near_legal(w)
        if near and (near != "llc" or len(words) > 2 and w not in v.short):
            return words[:-1], near
    return words, form


def words_of(s: str) -> list[str]:
    """Lower-case words; dotted initials joined for legal forms (L.L.C.), letters taken from digits inside words."""
    s = JOINED.sub(" ", s).lower()
    if "l." in s:
        s = DOTTED_LP.sub("lp", DOTTED_LLC.sub("llc", s))
    s = s.replace("mr/ms", " ").replace("&", " and ").replace("+", " and ").translate(QUOTES)
    words = WORD.findall(s)
    if not DIGIT.search(s):
        return words
    return [w.translate(DIGITS) if len(w) > 3 and LETTER.search(w) and len(DIGIT.findall(w)) == 1 else w for w in words]


def parse_owner(s: str, v: Vocabulary | None = None) -> tuple[str, str, str, str, str]:
    """(kind, head, part, legal, bones): kind 'o' or 'p'; part is the trade, or the first name or initial; '' if not said."""
    v = v or vocabulary()
    raw = s.strip()
    comma = raw.find(",")
    if comma > 0:
        left, right = words_of(raw[:comma]), words_of(raw[comma + 1 :])
        rest, _ = _legal(["x", *right], v)
        if right and rest != ["x"]:
            # `Trade, Head Legal` and `Family, First M.`: what stands after the comma comes first
            t, took = v.trade_of(left)
            if t and took == len(left):
                body, form = _legal(right, v)
                head = "".join(w for w in body if w not in FILLER)
                if head:
                    return "o", head, t, form, bones(head)
            raw = raw[comma + 1 :] + " " + raw[:comma]
    words = [w for w in words_of(raw) if w not in ("mr", "ms", "mrs", "dr")]
    if not words:
        return "o", "", "", "", ""
    person = _person(words, v)
    if person:
        return person
    body, form = _legal(words, v)
    body = [w for w in body if w not in FILLER] or body
    trade, took = v.trade_of(body)
    if trade and took < len(body):
        body = body[:-took]
    else:
        trade = ""
        flat = "".join(body)
        for t, name in v.by_length:
            if flat.endswith(t) and len(flat) - len(t) >= 4:
                trade, body = name, [flat[: -len(t)]]
                break
    while len(body) > 1 and body[-1] in ("and", "n"):
        body = body[:-1]
    head = "".join(body)
    return "o", head, trade, form, bones(head)


def _person(words: list[str], v: Vocabulary) -> tuple[str, str, str, str, str] | None:
    rest = list(words)
    trailer = False
    while len(rest) > 1 and (rest[-1] in TRAILERS or rest[-1] == "and"):
        rest, trailer = rest[:-1], True
    if any(w in TRAILERS for w in rest[1:]):
        rest = [w for w in rest if w not in TRAILERS and w != "and"]
        trailer = True
    letters = [w for w in rest if len(w) <= 2 and w.isalpha() and w not in FIRST and w not in v.short and w not in ("co", "lp")]
    names = [w for w in rest if w not in letters]
    if len(names) > 2:  # a misspelt trailer
        names = [w for w in names if not _near_trailer(w)]
    given = [(i, v.first_name(w)) for i, w in enumerate(names)]
    given = [(i, f) for i, f in given if f]
    if given and len(names) >= 2:
        i, f = given[0]
        family = "".join(w for j, w in enumerate(names) if j != i)
        if names[-1] in LEGAL or (len(names) > 2 and v.trade_of(names)[0]):
            return None
        return ("p", family, f, "", bones(family)) if len(family) >= 3 else None
    if letters and len(names) == 1 and names[0] not in LEGAL and len(names[0]) >= 4:
        return "p", names[0], letters[0][0], "", bones(names[0])
    if trailer and len(names) >= 1 and not given:
        return None
    return None


OWNER = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "head", "part", "legal", "bones")])


def owner_form(trades: dict[str, list[str]] | None = None):
    """A column function that reads owners' names with a table of trades, by default TRADES."""
    known = None if trades is None else tuple((t, tuple(ss)) for t, ss in trades.items())

    @F.pandas_udf(OWNER)
    def read(s: pd.Series) -> pd.DataFrame:
        v = vocabulary(known)
        return pd.DataFrame([parse_owner(x or "", v) for x in s], columns=["kind", "head", "part", "legal", "bones"])

    return read


# fixed values: kinds of site and their short forms
SITE_TYPES = {
    "works": ["wks"], "plant": ["plt", "pl"], "terminal": ["term", "trml", "terml"], "depot": ["dpt", "dep"], "complex": ["cplx", "cmplx", "compl"], "campus": ["cmps", "cmpus"], "warehouse": ["whse", "wh", "whs", "warehse"],
    "quarry": ["qry"], "station": ["sta", "stn"], "mill": ["ml"], "lab": ["laboratory"], "yard": ["yd"], "creamery": ["crmy", "crm"], "kiln": ["kln"], "tank farm": ["tf", "tnk fm", "tank fm", "tk farm"], "shop": [], "facility": ["fac", "fclty"],
    "office": ["ofc", "off"], "factory": ["fcty"], "foundry works": [], "center": ["ctr"],
}
# fixed values: words that tell sites of one owner apart
LANDMARKS = {"chapel", "orchard", "tannery", "canal", "foundry", "landing", "furnace", "ferry"}
SIDES = {
    "north": "n", "south": "s", "east": "e", "west": "w", "upper": "", "lower": "", "old": "", "new": "", "hillside": "", "harbor": "hbr", "river": "riv", "ridge": "rdg", "central": "ctrl", "main": "", "lake": "lk", "valley": "vly",
    "inner": "", "outer": "", "middle": "", "first": "", "second": "", "annex": "", "grove": "",
}
ROADS = {"road": "rd", "street": "st", "lane": "ln", "pike": "pk", "highway": "hwy", "avenue": "ave", "drive": "dr", "way": "wy", "court": "ct"}
UNIT_WORDS = {"unit", "u", "bldg", "building", "block", "blk", "hall", "bay"}
NUMBER_WORDS = {"no", "nbr", "num", "number", "nr", "nmbr"}
FORMER = r"\(\s*(?:ex|fka|f/k/a|formerly|former|was|aka|a/k/a|dba|d/b/a|prev|previously)\b[ .:]*(.*?)\)?$"
TYPE_OF = {s: t for t, ss in SITE_TYPES.items() for s in [t, *ss]}
SIDE_OF = {s: t for t, x in SIDES.items() for s in [t, *x.split()] if len(s) > 1}
ROAD_WORDS = {x for k, v in ROADS.items() for x in (k, v)}


def _tell_apart(words: list[str], towns: frozenset[str], only: bool) -> tuple[list[str], list[str], str]:
    """Words left for the owner, the marks that tell sites apart, and the kind of site. `only`: there is no other piece."""
    left, marks, kind, i = [], [], "", 0
    while i < len(words):
        w, after, later = words[i], words[i + 1] if i + 1 < len(words) else "", words[i + 2] if i + 2 < len(words) else ""
        pair, step = f"{w} {after}", 1
        if later and _squeeze(pair + later) in towns or (after == "court" and later == "house"):
            marks.append(f"t{_squeeze(pair + later)}")
            step = 3
        elif after and _squeeze(pair) in towns:
            marks.append(f"t{_squeeze(pair)}")
            step = 2
        elif w in NUMBER_WORDS and after.isdigit():
            marks.append(f"n{int(after)}")
            step = 2
        elif w.isdigit():
            marks.append(f"n{int(w)}")
        elif w in UNIT_WORDS and (len(after) == 1 and after.isalnum() or re.fullmatch(r"[a-z]{0,2}[0-9]+[a-z]?", after)):
            marks.append(f"u{after}")
            step = 2
        elif pair in TYPE_OF or (w in TYPE_OF and after not in ROAD_WORDS and (left or i or len(words) == 1 and not only or after in TYPE_OF or after and w not in ("mill", "kiln"))):
            # of several kinds the last is the site's; an earlier one names a landmark (Old Mill Yard)
            if kind:
                marks.append(f"x{kind}")
            kind, step = (TYPE_OF[pair], 2) if pair in TYPE_OF else (TYPE_OF[w], 1)
        elif after in ROAD_WORDS and len(w) >= 3:
            marks.append(f"r{w}")
            step = 2
        elif w in SIDE_OF:
            marks.append(f"d{SIDE_OF[w]}")
        elif w in LANDMARKS:
            marks.append(f"x{w}")
        elif w in towns and len(w) >= 5:
            marks.append(f"t{w}")
        else:
            left.append(w)
        i += step
    return left, marks, kind


def _guess(words: list[str], towns: frozenset[str]) -> tuple[list[str], list[str], str]:
    """As _tell_apart for the words left over after an owner: misspelt marks and kinds."""
    left, marks, kind = [], [], ""
    for w in words:
        what, read = _misspelt(w, towns)
        if what == "kind":
            kind = read
        elif what:
            marks.append(read)
        else:
            left.append(w)
    return left, marks, kind


@functools.lru_cache(MEMORY)
def _misspelt(w: str, towns: frozenset[str]) -> tuple[str, str]:
    """('kind', kind of site), ('mark', mark) or ('', '') for a word that may misspell one."""
    near = [t for k, t in TYPE_OF.items() if len(k) >= 4 and " " not in k and edits(w, k, 1) <= 1]
    if near:
        return "kind", near[0]
    side = [t for k, t in SIDE_OF.items() if len(k) >= 5 and edits(w, k, 1) <= 1]
    if side:
        return "mark", f"d{side[0]}"
    town = [t for t in towns if len(w) >= 6 and w[0] == t[0] and abs(len(t) - len(w)) <= 2 and edits(w, t, 2) <= 2]
    return ("mark", f"t{min(town)}") if town else ("", "")


def parse_site(s: str, towns: frozenset[str] = frozenset()) -> list[tuple[str, str, str, str, str, str]]:
    """[(kind of owner, head, part, bones, marks, kind of site)] of each name given: the present one, then a former one in brackets."""
    former = re.search(FORMER, s, re.I)
    said = [re.sub(FORMER, " ", s, flags=re.I)] + ([former.group(1)] if former else [])
    out = []
    for raw in said:
        raw = re.sub(r"#\s*(\d+)", r" no \1 ", raw)
        raw = re.sub(r"\b([Uu]|[Uu]nit|[Bb]ldg|UNIT|BLDG)-([A-Za-z0-9])\b", r"\1 \2", raw)
        flat = raw.replace("(", " ").replace(")", " ").replace(" - ", " ")
        pieces = flat.split(",")
        # the owner may stand after a comma: read each piece, then join what is left in order of speech
        lefts, marks, kind = [], [], ""
        for piece in pieces:
            left, m, k = _tell_apart(words_of(piece), towns, len(pieces) == 1)
            marks += m
            if k and kind:
                marks.append(f"x{kind}")
            kind = k or kind
            if left:
                lefts.append(" ".join(left))
        owner = parse_owner(", ".join(lefts) if len(lefts) > 1 and len(lefts) <= 2 else " ".join(lefts))
        rest = [w for x in lefts for w in x.split()]
        if owner[0] == "o" and len(rest) > 1 and len(owner[1]) > 16 or (owner[0] == "o" and not owner[2] and len(rest) > 1):
            owner, extra = _owner_inside(rest, towns)
            marks += extra[1]
            kind = kind or extra[2]
        elif owner[0] == "p" and len(rest) > 2:
            owner, extra = _owner_inside(rest, towns)
            marks += extra[1]
            kind = kind or extra[2]
        out.append((owner[0], owner[1], owner[2], owner[4], " ".join(sorted(set(marks))), kind))
    return [x for x in out if x[1]]


def _owner_inside(rest: list[str], towns: frozenset[str]):
    """The owner among words of which some misspell a mark or a kind of site."""
    left, marks, kind = _guess(rest, towns)
    if not left:
        left, marks, kind = rest, [], ""
    owner = parse_owner(" ".join(left))
    if owner[0] == "o" and not owner[2] and len(left) > 1:
        # head, trade, and words that could not be read: the first trade after the first word counts
        for k in range(2, len(left) + 1):
            trade, took = vocabulary().trade_of(left[:k])
            if trade and took < k:
                head = "".join(left[: k - took])
                return ("o", head, trade, "", bones(head)), (left, marks, kind)
        long = [w for w in left if len(w) >= 6 and w not in FILLER]
        if long and len(owner[1]) > 15:
            return ("o", long[0], "", "", bones(long[0])), (left, marks, kind)
    return owner, (left, marks, kind)
