"""Variant spellings of names typed by people, linked by merge and rematch.

Every distinct spelling becomes a small profile. Spellings that share a blocking
key are compared; profiles with matching spellings are merged, which unions
their spellings and initials, and the richer profiles are matched again until
nothing merges.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkledger.sources.session import cut, slots

# Words of company names and their usual short forms in English.
SHORT_FORMS = {
    "ADMINISTRATION": "ADMIN", "AMERICAN": "AMER AM", "ASSOCIATES": "ASSOC ASSOCS ASSC", "ASSOCIATION": "ASSN", "AUTOMOTIVE": "AUTO",
    "AVIATION": "AVN AVIA", "BROTHERS": "BROS", "BUILDERS": "BLDRS", "BUILDING": "BLDG", "CENTER": "CTR CNTR", "CHEMICAL": "CHEM",
    "COMMUNICATIONS": "COMM COMMS COMMUN", "COMPUTER": "COMP", "CONSTRUCTION": "CONSTR CONST CNSTR", "CONSULTING": "CONSULT CNSLTG",
    "CONTRACTING": "CONTR", "DEFENSE": "DEF", "DEVELOPMENT": "DEV DEVT DEVEL", "DISTRIBUTION": "DIST DISTR DISTRIB", "DREDGING": "DREDG DRDG",
    "EDUCATION": "EDU EDUC", "ELECTRICAL": "ELEC ELECT ELECTR", "ELECTRONICS": "ELECTRON ELECS", "ENERGY": "ENGY", "ENGINEERING": "ENG ENGR ENGRG ENGG",
    "ENTERPRISES": "ENT ENTPR", "ENVIRONMENTAL": "ENV ENVTL ENVIR ENVIRON", "EQUIPMENT": "EQUIP EQPT", "FINANCIAL": "FIN", "FOODS": "FDS FD",
    "GENERAL": "GEN", "GLOBAL": "GLBL", "GOVERNMENT": "GOVT", "GROUP": "GRP GP", "HOLDINGS": "HLDGS HLDG", "HOSPITAL": "HOSP", "HYDRAULICS": "HYDR HYD HYDRAUL",
    "INDUSTRIES": "IND INDS", "INSTITUTE": "INST", "INSTRUMENTS": "INSTR", "INTERNATIONAL": "INTL INTNL INTERNATL", "LABORATORIES": "LAB LABS", "LOGISTICS": "LOG LOGS LOGIS",
    "MACHINERY": "MACH", "MAINTENANCE": "MAINT MTCE MNT", "MANAGEMENT": "MGMT MGT MANAG", "MANUFACTURING": "MFG MANUF MANUFG", "MARINE": "MAR MRN",
    "MARKETING": "MKTG", "MECHANICAL": "MECH", "MEDICAL": "MED MEDCL", "NATIONAL": "NATL NAT", "OPTICS": "OPT OPTS", "PHARMACEUTICAL": "PHARM", "PRODUCTS": "PROD PRODS",
    "PROFESSIONAL": "PROF", "RESEARCH": "RES RSCH", "ROOFING": "RFG ROOF", "SCIENTIFIC": "SCI", "SECURITY": "SEC", "SERVICES": "SVC SVCS SERV SERVS", "SHIPPING": "SHPG",
    "SOLUTIONS": "SOLN SOLNS", "SUPPLY": "SUP SPLY", "SYSTEMS": "SYS SYST", "TECHNICAL": "TECHN", "TECHNOLOGIES": "TECH TECHS TECHNOL", "TEXTILE": "TXTL TEX TEXT",
    "TIMBER": "TMBR TIMB", "TRANSPORTATION": "TRANSP TRANS TRANSPORT", "UNIVERSITY": "UNIV", "WAREHOUSE": "WHSE",
}
# Legal forms and words that say nothing about who it is.
LEGAL = ("INCORPORATED INC CORPORATION CORP COMPANY CO LIMITED LTD LIABILITY LLC LLP LP PLC PARTNERS PTNRS PARTNERSHIP GMBH SA AG BV PTY LC PC").split()
NOISE = ("THE AND OF REGISTERED DBA").split()
# Given names in English and what their bearers are called.
NICKNAMES = {
    "ALEXANDER": "ALEX SANDY AL LEX", "ALFRED": "FRED ALF", "ANDREW": "ANDY DREW", "ANTHONY": "TONY", "BARBARA": "BARB BABS", "BENJAMIN": "BEN BENNY",
    "CATHERINE": "CATHY CATE", "CHARLES": "CHARLIE CHUCK", "CHRISTINE": "CHRIS TINA", "CHRISTOPHER": "CHRIS KIT TOPHER", "DANIEL": "DAN DANNY",
    "DAVID": "DAVE", "DEBORAH": "DEB DEBBIE DEBBY", "DONALD": "DON DONNIE", "DOROTHY": "DOT DOTTIE", "EDWARD": "ED EDDIE NED TED TEDDY",
    "ELIZABETH": "LIZ BETH BETTY LIZZIE ELIZA BESS LIBBY", "FRANCIS": "FRANK", "FREDERICK": "FRED", "GERALD": "GERRY JERRY", "GREGORY": "GREG", "HENRY": "HANK HARRY",
    "JACQUELINE": "JACKIE", "JAMES": "JIM JIMMY JAMIE", "JENNIFER": "JEN JENNY", "JOHN": "JACK JOHNNY", "JOSEPH": "JOE JOEY", "JOSEPHINE": "JO JOSIE",
    "KATHERINE": "KATE KATHY KAT KATIE KIT KAY", "KENNETH": "KEN", "LAWRENCE": "LARRY LAURIE", "LEONARD": "LEN LEO", "MARGARET": "MAGGIE MEG PEGGY MARGE RITA PEG",
    "MATTHEW": "MATT", "MICHAEL": "MIKE MICK", "NATHANIEL": "NAT NATE NATHAN", "NICHOLAS": "NICK", "PATRICIA": "PAT PATTY TRISH TRICIA PATSY",
    "PATRICK": "PAT PADDY", "PETER": "PETE", "REBECCA": "BECKY", "RICHARD": "DICK RICK RICH RICKY", "ROBERT": "BOB ROB BOBBY ROBBIE BERT", "RONALD": "RON",
    "SAMUEL": "SAM", "SANDRA": "SANDY", "STEPHEN": "STEVE", "SUSAN": "SUE SUSIE", "SUSANNAH": "SUE SUSIE SUZY SUSAN ANNA", "THEODORE": "TED TEDDY THEO", "THOMAS": "TOM TOMMY",
    "TIMOTHY": "TIM", "VICTORIA": "VICKY", "VINCENT": "VINCE", "VIRGINIA": "GINNY", "WALTER": "WALT", "WILLIAM": "BILL BILLY WILL WILLIE LIAM",
}

_EXPAND = {s: w for w, forms in SHORT_FORMS.items() for s in forms.split()}
_GIVEN: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _n in (_full, *_short.split()):
        _GIVEN[_n] = _GIVEN.get(_n, frozenset()) | {_full}
_DIGITS = str.maketrans("0135", "OIES")
_LONGEST_FIRST = sorted(SHORT_FORMS, key=len, reverse=True)


def deletions(w: str, depth: int) -> set[str]:
    """``w`` and what remains when up to ``depth`` characters are left out."""
    out = {w}
    for d in range(1, depth + 1):
        out.update("".join(c for i, c in enumerate(w) if i not in gone) for gone in combinations(range(len(w)), d))
    return out


def reach(w: str) -> int:
    """Typing errors allowed in a word."""
    return 2 if len(w) >= 8 else 1 if len(w) >= 5 else 0


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or limit + 1 if more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    # cells further than limit off the diagonal cost more than limit; each row holds j = i - limit to i + limit
    far = limit + 1
    width = 2 * limit + 1
    before: list[int] = []
    row = [j if j >= 0 else far for j in range(-limit, limit + 1)]
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [far] * width
        for k in range(max(0, limit - i), min(width, len(b) - i + limit + 1)):
            j = i - limit + k
            if j == 0:
                row[k] = min(i, far)
                continue
            y = b[j - 1]
            cost = min(before[k] + (x != y), before[k + 1] + 1 if k + 1 < width else far, row[k - 1] + 1 if k else far)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[k] + 1)
            row[k] = min(cost, far)
        if min(row) > limit:
            return far
    return row[len(b) - len(a) + limit]


# The letter rows of a typewriter.
ROWS = ("QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM")
_AT = {c: (r, i + r / 2) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
#: Cores of fewer letters than this that differ by two replaced letters alone are taken for two names.
TELLING = 14


def beside_each_other(x: str, y: str) -> bool:
    """True for letters of which one is easily hit in place of the other."""
    return x in _AT and y in _AT and abs(_AT[x][0] - _AT[y][0]) <= 1 and abs(_AT[x][1] - _AT[y][1]) <= 1


def typos(a: str, b: str, limit: int) -> int:
    """Typing errors from core a to core b, or limit + 1 if more, or if they are none.

    Letters left out, doubled or swapped are slips at any length. Two letters
    replaced, neither pair side by side on the keyboard, are as a rule another
    name if the core is short: names of one pattern differ like that.
    """
    d = distance(a, b, limit)
    if d == 2 and len(a) == len(b) < TELLING:
        changed = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if len(changed) == 2 and not all(beside_each_other(x, y) for x, y in changed):
            return limit + 1
    return d


#: Words longer than this are no known word.
WORDY = 24
#: Cores longer than this are blocked by their segments, which are fewer keys; shorter ones by left-out characters. Both lose no pair.
SEGMENTED = 8
#: Members of a block beyond which it is searched by left-out characters in place of pair by pair.
CROWD = 32


def _index(known: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w in known:
        for d in deletions(w, reach(w)) if len(w) >= 5 else ():
            out.setdefault(d, []).append(w)
    return out


_NEAR = _index([*SHORT_FORMS, *[w for w in LEGAL if len(w) > 5], *[n for n in _GIVEN if len(n) > 5]])


@lru_cache(maxsize=100_000)
def snap(token: str) -> str:
    """The known word of which the token is a short form or a typing error, else itself."""
    if token in _EXPAND:
        return _EXPAND[token]
    if token in SHORT_FORMS or token in LEGAL or token in _GIVEN or not 5 <= len(token) <= WORDY:
        return token
    near = {w for d in deletions(token, reach(token)) for w in _NEAR.get(d, ())}
    best = min(((distance(token, w, 2), w) for w in near), default=(9, ""))
    return best[1] if best[0] <= min(reach(token), reach(best[1])) else token


@lru_cache(maxsize=100_000)
def _unglue(token: str) -> tuple[str, ...]:
    """Cut off a known word, its short form or a mistyped long one that sticks to another word."""
    for w in _LONGEST_FIRST:
        if len(token) - len(w) >= 4 and len(w) >= 4:
            if token.endswith(w):
                return (token[: -len(w)], w)
            if token.startswith(w):
                return (w, token[len(w) :])
    for at in range(6, min(len(token), 2 * WORDY) - 2):
        tail = token[at:]
        if (tail in _EXPAND and tail[-1] not in "AEIOUY") or (len(tail) >= 7 and snap(tail) in SHORT_FORMS and distance(tail, snap(tail), 1) <= 1):
            return (token[:at], tail)
    return (token,)


@lru_cache(maxsize=100_000)
def spelling(name: str) -> str:
    """A name in canonical form: kind|core|words|given|initials.

    Kind is O (organisation) or P (person). Accents, case, punctuation, word
    order, legal forms and filler go; short forms are written out, typing errors
    in known words are mended, a known word stuck to another is cut off, and a
    nickname stands for every name it is short for.
    """
    plain = name.upper()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    plain = plain.replace(".", "").replace("'", "")
    plain = re.sub(r"\bL L ?C\b", "LLC", re.sub(r"\bL L ?P\b", "LLP", plain))
    typed = [t.translate(_DIGITS) if len(t) >= 3 and not t.isdigit() else t for t in re.findall(r"[^\W_]+", plain)]
    known = lambda t: t in SHORT_FORMS or t in LEGAL or t in NOISE or t in _GIVEN
    typed = [x for t in typed for x in ((t,) if known(t) or known(snap(t)) else _unglue(t))]
    # a nickname that is also a short form is the latter only beside other words of a company
    unclear = {t for t in typed if t in _GIVEN and t in _EXPAND}
    org = any(snap(t) in SHORT_FORMS or snap(t) in LEGAL for t in typed if t not in unclear)
    tokens = [snap(t) if org or t not in unclear else t for t in typed]
    tokens = [t for t in tokens if t not in NOISE]
    given = [t for t in tokens if t in _GIVEN]
    if not org and given and 2 <= len(tokens) <= 5:
        first = given[0]
        rest = list(tokens)
        rest.remove(first)
        initials = sorted({t for t in rest if len(t) == 1})
        core = sorted(t for t in rest if len(t) > 1)
        if core:
            return "|".join(("P", " ".join(core), "", " ".join(sorted(_GIVEN[first])), " ".join(initials)))
    named = [t for t in tokens if t not in LEGAL]
    core = sorted(t for t in named if t not in SHORT_FORMS)
    words = sorted({t for t in named if t in SHORT_FORMS})
    if not core:
        core, words = words or sorted(tokens) or [plain.strip()], []
    return "|".join(("O", " ".join(core), " ".join(words), "", ""))


def segments(w: str) -> set[str]:
    """Keys of which two words of any length share one if at most two edits lie between them.

    Three segments with one character between them: an edit touches at most one
    of them, a swap of neighbours too, so two edits leave one as it is. A word
    gives its own segments, and what stands where those of a word up to two
    characters shorter can have moved.
    """
    out = set()
    for less in range(min(3, len(w))):
        n = len(w) - less
        a, b = (n - 2) // 3, (2 * n - 1) // 3
        for part, (lo, hi) in enumerate(((0, a), (a + 1, b), (b + 1, n))):
            for moved in range(-1, 3):
                if abs(moved) + abs(less - moved) <= 2 and 0 <= lo + moved and hi + moved <= len(w):
                    out.add(f"{n}.{part}.{w[lo + moved : hi + moved]}")
    return out


def nodes(form: str) -> list[str]:
    """What spellings must agree in exactly (words of a company; a given name), before the letters of the core."""
    kind, core, words, given, _ = form.split("|")
    joined = core.replace(" ", "")
    return [f"{kind}{b}|{joined}" for b in (given.split() if kind == "P" else [words])]


def keys(node: str) -> set[str]:
    """Blocking keys: what must agree with the core with up to two characters left out, or with its segments.

    Cores two characters short of the long ones have both kinds.
    """
    beside, joined = node.rsplit("|", 1)
    cores = deletions(joined, reach(joined)) if len(joined) <= SEGMENTED else {joined}
    if len(joined) > SEGMENTED - 2:
        cores |= segments(joined)
    return {f"{beside}|{d}" for d in cores}


@lru_cache(maxsize=500_000)
def same(a: str, b: str) -> bool:
    """True if two canonical forms can be spellings of one name."""
    ka, ca, wa, ga, ia = a.split("|")
    kb, cb, wb, gb, ib = b.split("|")
    if ka != kb or (ia and ib and not set(ia.split()) & set(ib.split())) or (ga or gb) and not set(ga.split()) & set(gb.split()):
        return False
    x, y = ca.replace(" ", ""), cb.replace(" ", "")
    limit = min(reach(x), reach(y))
    if x != y and (limit == 0 or typos(x, y, limit) > limit):
        return False
    left, right = set(wa.split()), set(wb.split())
    return left == right


def near(members: list[str]) -> Iterator[tuple[str, str, int]]:
    """Pairs of one block's nodes that agree beside the core, with the edits between their cores."""
    split = [m.rsplit("|", 1) for m in members]
    letters = [sum(1 << c for c in {ord(c) & 63 for c in core}) for _, core in split]
    pairs: Iterator[tuple[int, int]] = combinations(range(len(members)), 2)
    if len(members) > CROWD:
        index: dict[tuple[str, str], list[int]] = {}
        for i, (beside, core) in enumerate(split):
            for d in deletions(core, reach(core)):
                index.setdefault((beside, d), []).append(i)
        pairs = iter({p for own in index.values() for p in combinations(own, 2)})
    for i, j in pairs:
        # an edit brings at most one letter and takes at most one away
        if (letters[i] ^ letters[j]).bit_count() > 4:
            continue
        (a, x), (b, y) = split[i], split[j]
        limit = min(reach(x), reach(y))
        if a == b and limit and (d := typos(x, y, limit)) <= limit:
            yield (*sorted((members[i], members[j])), d)


def _neighbours(names: DataFrame) -> DataFrame:
    """a, b, d for nodes (column node, each once) that typing errors may have turned into each other."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                own = b.column(0).slice(lo, 2000).to_pylist()
                several = [keys(n) for n in own]
                at = np.repeat(np.arange(len(own), dtype=np.int32), [len(k) for k in several])
                yield pa.RecordBatch.from_arrays([pa.array([k for ks in several for k in ks]), pa.array(own).take(pa.array(at))], names=["key", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str, int]] = set()
        left: list[pa.RecordBatch] = []  # what may go on: the last block so far
        for b in _then_none(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                left.append(b)
                if left[0].column(0)[0].as_py() == b.column(0)[-1].as_py():
                    continue
            if not left:
                continue
            whole = pa.Table.from_batches(left).combine_chunks()
            k = whole.column(0).to_numpy()
            begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            done = len(k) if b is None else int(begin[-1])
            left = [] if b is None else whole.slice(done).to_batches()
            sizes = np.diff(np.r_[begin, len(k)])
            several = (sizes > 1) & (begin < done)
            rows = np.repeat(several, sizes)
            own = whole.column(1).filter(pa.array(rows)).to_pylist()
            at = 0
            for n in sizes[several].tolist():
                found.update(near(own[at : at + n]))
                at += n
            if len(found) > 100_000:
                yield _rows(found)
                found = set()
        yield _rows(found)

    entries = names.repartition(2 * slots(names.sparkSession)).mapInArrow(enter, "key string, node string")
    rows = entries.select(F.xxhash64("key").alias("key"), "node").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(compare, "a string, b string, d int").distinct()


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _rows(found: set[tuple[str, str, int]]) -> pa.RecordBatch:
    a, b, d = zip(*sorted(found), strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(d, pa.int32())], names=["a", "b", "d"])


def agree(initials: set[str], given: set[str], more_initials: set[str], more_given: set[str]) -> bool:
    """False where initials or given names contradict each other."""
    return not (initials and more_initials and not initials & more_initials) and not ((given or more_given) and not given & more_given)


def _agree(a: str, b: str) -> Column:
    """The same of columns a_initials and so on."""
    i, j, g, h = (F.col(f"{x}_{k}") for k in ("initials", "given") for x in (a, b))
    return ~((F.size(i) > 0) & (F.size(j) > 0) & ~F.arrays_overlap(i, j)) & ~(((F.size(g) > 0) | (F.size(h) > 0)) & ~F.coalesce(F.arrays_overlap(g, h), F.lit(False)))


def _accept(proposals: DataFrame) -> DataFrame:
    """tail, head: each head takes its proposals in order, those that agree with what it has become by then."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, initials, given = None, set(), set()
        for b in batches:
            taken = []
            for h, t, hi, hg, ti, tg in zip(*(b.column(c).to_pylist() for c in ("head", "tail", "head_initials", "head_given", "tail_initials", "tail_given")), strict=True):
                if h != head:
                    head, initials, given = h, set(hi), set(hg)
                if agree(initials, given, set(ti), set(tg)):
                    initials |= set(ti)
                    given &= set(tg)
                    taken.append((t, h))
            t, h = zip(*taken, strict=True) if taken else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(h, pa.string())], names=["tail", "head"])

    ordered = proposals.repartition("head").sortWithinPartitions("head", "d", "tail").drop("d")
    return ordered.mapInArrow(grow, "tail string, head string")


def _renamed(df: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    new = merged.select(F.col("tail").alias(column), F.col("head").alias("_head"))
    return df.join(new, column, "left").withColumn(column, F.coalesce("_head", column)).drop("_head")


def resolve_names(df: DataFrame, id: Column, name: Column) -> DataFrame:
    """Which ids bear spellings of the same name: id, entity.

    ``entity`` is the least canonical spelling of the merged profile. An id with
    names of several entities has a row for each. Null names and null ids take
    no part; a name without letters or digits stands for itself. Repeated rows
    change nothing; an empty table gives no rows.

    Distinct canonical spellings are all that is compared, so a name that a
    third of the rows bear counts once. Two are linked if they agree in the
    words of a company or a given name and in their initials, and at most two
    typing errors (see ``typos``) lie between the rest.

    Profiles merge along links, in rounds: each proposes to the lowest of its
    partners (by an order drawn anew each round, profiles with initials first; a
    person without any initial to the most alike), and those that don't propose
    themselves take their proposals one by one. A merged profile has the
    initials of all its spellings and the given names that all of them allow,
    and comes back with its links in the next round; none is ever merged with
    one that it contradicts, however many spellings lie between them.
    """

    def canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spelling(n) for n in b.column(1).to_pylist()], pa.string())], names=["id", "pid"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = b.column(0).to_pylist()
            words = [f.split("|") for f in forms]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([nodes(f) for f in forms], pa.list_(pa.string())), pa.array([w[4].split() for w in words], pa.list_(pa.string())), pa.array([w[3].split() for w in words], pa.list_(pa.string()))], names=["pid", "nodes", "initials", "given"])

    named = df.select(id.cast("string").alias("id"), name.cast("string").alias("name")).where("id is not null and name is not null").distinct()
    spelled = cut(named.mapInArrow(canonical, "id string, pid string").distinct())
    forms = cut(spelled.select("pid").distinct().mapInArrow(places, "pid string, nodes array<string>, initials array<string>, given array<string>"))
    at = forms.select("pid", "initials", "given", F.explode("nodes").alias("node"))
    side = lambda x: at.select(F.col("node").alias(f"{x}_node"), F.col("pid").alias(x), F.col("initials").alias(f"{x}_initials"), F.col("given").alias(f"{x}_given"))
    here = side("a").join(side("b"), F.col("a_node") == F.col("b_node")).where("a < b").withColumn("d", F.lit(0))
    typos = cut(_neighbours(at.select("node").distinct())).select(F.col("a").alias("a_node"), F.col("b").alias("b_node"), "d")
    there = typos.join(side("a"), "a_node").join(side("b"), "b_node").where("a <> b")
    linked = here.unionByName(there).where(_agree("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    links = cut(linked.groupBy("a", "b").agg(F.min("d").alias("d")))
    entity = forms.select("pid", F.col("pid").alias("entity"))
    profile = forms.select(F.col("pid").alias("entity"), "initials", "given")
    turn = 0
    while True:
        own = lambda x: profile.select(F.col("entity").alias(x), F.col("initials").alias(f"{x}_initials"), F.col("given").alias(f"{x}_given"))  # noqa: B023, E731
        both = links.join(own("a"), "a").join(own("b"), "b").where(_agree("a", "b"))
        rank = lambda x: F.struct((F.size(f"{x}_initials") == 0).alias("bare"), F.xxhash64(F.lit(turn), x).alias("drawn"), F.col(x).alias("by"))  # noqa: B023, E731
        up = F.when(rank("b") < rank("a"), F.struct(*[F.col(f"{x}{k}").alias(f"{y}{k}") for x, y in (("b", "head"), ("a", "tail")) for k in ("", "_initials", "_given")], rank("b").alias("rank")))
        down = F.struct(*[F.col(f"{x}{k}").alias(f"{y}{k}") for x, y in (("a", "head"), ("b", "tail")) for k in ("", "_initials", "_given")], rank("a").alias("rank"))
        asked = both.select("d", F.coalesce(up, down).alias("x")).select("d", "x.*")
        doubt = F.when((F.size("tail_given") > 0) & (F.size("tail_initials") == 0), F.col("d")).otherwise(0)
        best = asked.groupBy("tail").agg(F.min(F.struct(doubt.alias("doubt"), "rank", "head", "d", "head_initials", "head_given", "tail_initials", "tail_given")).alias("p")).select("tail", "p.*")
        best = cut(best.drop("doubt", "rank"))
        merged = cut(_accept(best.join(best.select(F.col("tail").alias("head")), "head", "left_anti")))
        if merged.isEmpty():
            break
        entity = cut(_renamed(entity, merged, "entity"))
        gathered = _renamed(profile, merged, "entity").groupBy("entity").agg(F.array_distinct(F.flatten(F.collect_set("initials"))).alias("initials"), F.collect_set("given").alias("givens"))
        profile = cut(gathered.select("entity", "initials", F.aggregate("givens", F.get("givens", F.lit(0)), F.array_intersect).alias("given")))
        links = _renamed(_renamed(links, merged, "a"), merged, "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
        links = cut(links)
        turn += 1
    named = entity.groupBy("entity").agg(F.min("pid").alias("least"))
    return spelled.join(entity, "pid").join(named, "entity").select("id", F.col("least").alias("entity")).distinct()
