"""Spellings of one person or organisation: names sharded into tries, walked with Levenshtein automata.

A name is taken apart into its core (surname, or the proper words of an organisation in any order) and what
tells bearers of one core apart (given name or its initial, line of business). Of two cores within one edit the
first or the last half is the same, so each workspace's cores are sharded by both halves; every shard is a trie of
what remains, in which all its cores are searched for. Only cores of the same workspace whose other parts agree,
in any order of the parts, are linked.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.automata import build_trie, search
from loomgraph.llm.matches import connected_groups
from loomgraph.llm.survivors import STAND_INS
from loomgraph.session import cut_lineage, distinct_records

SHARD_NAMES = 2_000  # cores of a shard from which on it is split
UNLISTED_LETTERS = 6  # letters from which on given names that are in no list may differ by one edit
CLASS_BLOCK = 1_000  # spellings of one bearer that are paired in one task

# Given names with the short forms that they go by.
SHORT_FORMS = {
    "abigail": "abby abbie gail", "alexander": "alex sasha xander sandy alec", "anthony": "tony ant", "benjamin": "ben benny benji",
    "charlotte": "lottie charlie lotte", "christopher": "chris kit topher", "dorothea": "dora dot dottie thea dorothy",
    "edward": "ed eddie ned ted teddy", "elizabeth": "liz beth betty lizzie eliza bess libby", "francesca": "fran franny cesca",
    "frederick": "fred freddie freddy", "gabriela": "gaby gabi gabby gabriella", "gregory": "greg", "henrietta": "hettie etta hetty",
    "isabella": "bella izzy isa", "johannes": "hannes johann hans jo", "josephine": "josie jo", "katherine": "kathy kate katie kat kitty catherine cathy",
    "lawrence": "larry laurie", "leonard": "leo len lenny", "margaret": "maggie peggy meg marge", "maximilian": "max",
    "michael": "mike mick mickey", "nikolai": "kolya nick niko", "oliver": "ollie", "philippa": "pip pippa", "rebecca": "becky becca",
    "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve steph steven",
    "susanna": "sue susie suzy", "theodore": "theo ted teddy", "thomas": "tom tommy", "ulrike": "ulli uli rike", "victoria": "vicky vic tori",
    "wilhelmina": "mina willa minnie billie", "william": "bill will billy willy liam", "yvonne": "vonnie evie", "zacharias": "zach zack",
    "andrew": "andy drew", "daniel": "dan danny", "david": "dave davy", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "john": "jack johnny", "joseph": "joe joey", "matthew": "matt", "nicholas": "nick nicky", "patricia": "pat patty trish", "peter": "pete",
    "ronald": "ron", "timothy": "tim",
}
# Titles and additions to a person's name.
TITLES = frozenset("mr mrs ms miss dr prof professor rev reverend capt captain sir lady lord herr frau dipl ing jr sr phd md esq fr don dona mme hon col gen lt sgt".split())
# Legal forms.
LEGAL = frozenset(
    "corp corporation inc incorporated ltd limited gmbh ag aktiengesellschaft llc llp plc co company kg ohg sa sarl se spa bv nv oy ab as pty lp ev mbh".split()
)
# Words for a line of business, with short forms.
BUSINESS = {
    "technologies": "tech technology technol techs", "engineering": "eng engin engr engng", "manufacturing": "mfg manuf mfr", "logistics": "log logist",
    "foods": "fds food fd", "associates": "assoc assocs asso associate", "laboratories": "labs lab laboratory labor", "dynamics": "dyn dynam",
    "university": "univ uni", "institute": "inst institut", "research": "res rsch rsrch", "international": "intl int internat", "trading": "trad trdg trade",
    "publishing": "publ pub publg", "house": "hse hs", "department": "dept dep dpt", "works": "wks wrks", "brothers": "bros bro", "sons": "son",
    "group": "grp", "holdings": "hldgs holding", "partners": "ptnrs", "systems": "sys syst", "services": "svcs svc serv", "solutions": "sol solns",
    "industries": "ind inds", "consulting": "cons consult", "bank": "bk", "insurance": "ins", "energy": "", "media": "", "school": "sch",
    "college": "coll", "hospital": "hosp", "museum": "mus", "society": "soc", "agency": "agcy", "foundation": "fdn found", "ministry": "min",
}
_FILLERS = frozenset("the and of for und der die das y de la".split())
# Particles before a surname, which many leave out.
_PARTICLES = frozenset("de la del las los da do dos di du van von der den ten ter zu zur al el bin ibn".split())
PERSON_TYPES = frozenset("person people human individual per".split())
ORGANISATION_TYPES = frozenset("organization organisation org company corporation firm business institution".split())

_GIVEN = {name: name for name in SHORT_FORMS}
for _name, _shorts in SHORT_FORMS.items():
    for _short in _shorts.split():
        _GIVEN.setdefault(_short, _name)
# A short form of several names stands for each of them.
_SHARED = {s: {n for n, short in SHORT_FORMS.items() if s in short.split()} for names in SHORT_FORMS.values() for s in names.split()}
_SHARED = {s: names for s, names in _SHARED.items() if len(names) > 1}
_BUSINESS = {w: w for w in BUSINESS} | {s: w for w, shorts in BUSINESS.items() for s in shorts.split()}


def letters(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def folded(word: str) -> str:
    """Spellings that sound alike as one: ph and f, y and i, th and t, c and k, w and v."""
    for a, b in (("ph", "f"), ("th", "t"), ("ck", "k"), ("y", "i"), ("ß", "s"), ("c", "k"), ("w", "v")):
        word = word.replace(a, b)
    return word


def sounded(word: str) -> str:
    """Folded, and doubled letters as one."""
    return re.sub(r"(.)\1+", r"\1", folded(word))


def _one_edit(word: str) -> set[str]:
    """The word and what a letter less leaves of it."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


_NEAR_GIVEN: dict[str, set[str]] = {}
for _name in SHORT_FORMS:
    for _part in _one_edit(sounded(_name)) | _one_edit(_name):
        _NEAR_GIVEN.setdefault(_part, set()).add(_name)
_NEAR_BUSINESS: dict[str, set[str]] = {}
for _name in BUSINESS:
    for _part in _one_edit(_name):
        _NEAR_BUSINESS.setdefault(_part, set()).add(_name)


def within_one(a: str, b: str) -> bool:
    """At most one letter changed, added, left out, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x == y or x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(x) > 1 and x[2:] == y[2:])


def _near(word: str, table: dict[str, set[str]]) -> str | None:
    """The one name in the table that the word sounds like, else the one within an edit of it."""
    key = sounded(word)
    if len(key) < 4:
        return None
    found = {n for w in (key, word) for part in _one_edit(w) for n in table.get(part, ()) if within_one(w, sounded(n)) or within_one(w, n)}
    same = {n for n in found if sounded(n) == key}
    found = same or found
    return found.pop() if len(found) == 1 else None


@lru_cache(maxsize=100_000)
def given_name(word: str) -> str | None:
    return _GIVEN.get(word) or _near(word, _NEAR_GIVEN)


@lru_cache(maxsize=100_000)
def business_word(word: str) -> str | None:
    if word in _BUSINESS:
        return _BUSINESS[word]
    return _near(word, _NEAR_BUSINESS) if len(word) >= 5 else None


NAME = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "part", "core", "folded", "plain")])


def _undotted(plain: str) -> str:
    """g.m.b.h. as gmbh."""
    return re.sub(r"\b[a-z](?:\.[a-z])+\b\.?", lambda m: m.group().replace(".", ""), plain)


def parse_organisation(plain: str, sure: bool = True) -> tuple[str, str, str] | None:
    """The proper words in alphabetical order are the core; one alone if only a line of business shows the kind."""
    words = [w for w in re.split(r"[^\w]+|_", _undotted(plain)) if w and w not in LEGAL and w not in _FILLERS]
    lines, core = set(), []
    for w in words:
        if b := business_word(w):
            lines.add(b)
        elif not w.isdigit():
            core.append(w)
    if not core or len("".join(core)) < 3 or (len(core) > 1 and not sure):
        return None
    return "organisation", " ".join(sorted(lines)), " ".join(sorted(core))


def parse_person(plain: str, sure: bool) -> tuple[str, str, str] | None:
    """part is 'given', or 'i' after a colon for an initial, or empty for a surname alone. A given name that is
    in no list stands after a tilde."""
    before, comma, _ = plain.partition(",")
    split = lambda text: [w for w in re.split(r"[^\w']+|_", text) if w]
    words = [w for w in split(plain) if w not in TITLES]
    titled = len(words) < len(split(plain))
    if not words or any(c.isdigit() for w in words for c in w):
        return None
    full = [w for w in words if len(w) > 1 and w not in _PARTICLES] or [w for w in words if len(w) > 1]
    initials = [w for w in words if len(w) == 1]
    if len(full) == 1:
        if initials:
            return "person", f":{initials[0]}", full[0]
        return ("person", "", full[0]) if (sure or titled or len(words) == 1) and len(full[0]) >= 4 else None
    if len(full) > 3 and not sure:
        return None
    if not comma and full[0] in _GIVEN:
        known = [(0, _GIVEN[full[0]])]
    else:
        known = [(i, g) for i, w in enumerate(full) if (g := given_name(w))]
    surnames = len([w for w in split(before) if w in full]) if comma else 0
    if known:
        i, given = known[-1] if comma and len(known) == 1 else known[0]
        rest = full[:i] + full[i + 1 :]
        surname = rest[max(0, surnames - 1) if i >= surnames else 0] if comma else rest[-1]
        if full[i] in _SHARED:
            given = "/".join(sorted(_SHARED[full[i]]))
        return "person", given, surname
    if not sure:
        return None
    if 0 < surnames < len(full):
        return "person", f"~{sounded(full[surnames])}", full[surnames - 1]
    return "person", f"~{sounded(full[0])}", full[-1]


def parse_name(name: str | None, entity_type: str | None) -> tuple[str, str, str] | None:
    """(kind, part, core in plain letters), or None for what is no name of a person or organisation.

    The kind of a name without a type is told by a listed given name, a title, a legal form or a line of
    business; two capitalised words without any of these may be a person, of kind 'person?'.
    """
    if not name or not name.strip():
        return None
    plain = " ".join(letters(name).split()).strip(" .")
    if re.sub(r"\s", "", plain) in STAND_INS:
        return None
    kind = re.sub(r"\s", "", letters(entity_type or ""))
    open_type = kind in STAND_INS or not kind
    if kind in ORGANISATION_TYPES:
        return parse_organisation(plain)
    if kind in PERSON_TYPES:
        return parse_person(plain, True)
    if not open_type:
        return None
    words = set(re.split(r"[^\w]+", _undotted(plain)))
    if words & LEGAL:
        return parse_organisation(plain)
    person = parse_person(plain, False)
    if person is not None and person[1]:
        return person
    if any(w in _BUSINESS for w in words):
        return parse_organisation(plain, False)
    if person is None and re.fullmatch(r"\s*[^\W\d_]{2,},?\s+[^\W\d_]{3,}\s*", name) and all(w[0].isupper() and not w.isupper() for w in name.split()):
        found = parse_person(plain, True)
        return found and ("person?", *found[1:])
    return person


def _permuted(core: str) -> list[str]:
    """The words of a core in all orders, of more than four as they are."""
    words = core.split(" ")
    return [core] if len(words) == 1 or len(words) > 4 else sorted({" ".join(p) for p in itertools.permutations(words)})


def halves(core: str) -> list[tuple[str, str]]:
    """The shards of a core, each with the rest of the core that its trie holds.

    Where two cores are one edit apart and the shorter has n letters, the first or the last (n - 1) // 2
    letters of both are the same; the shorter may have one letter less than this one. What ends alike is held
    from the end to the beginning.
    """
    n, back = len(core), core[::-1]
    out = []
    for h in {max(0, (n - 1) // 2), max(0, (n - 2) // 2)}:
        out.append((f"<{core[:h]}", core[h:]))
        if h:
            out.append((f">{back[:h]}", back[h:]))
    return out


SHARDED = T.StructType([T.StructField("shard", T.StringType()), T.StructField("rest", T.StringType()), T.StructField("asks", T.BooleanType())])


@F.pandas_udf(T.ArrayType(SHARDED))
def _sharded(form: pd.Series) -> pd.Series:
    """Where a form is held, and, in the order that it has, searched for."""
    out = []
    for f in form:
        rows = {place: text == f for text in _permuted(f) for place in halves(text)}
        out.append([{"shard": shard, "rest": rest, "asks": asks} for (shard, rest), asks in rows.items()])
    return pd.Series(out)


def _search_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out: set[tuple] = set()
        for group, kind, members in zip(pdf.group_id, pdf.kind, pdf.members, strict=True):
            owners: dict[str, list[str]] = {}
            for m in members:
                if m["entry"]:
                    owners.setdefault(m["rest"], []).append(m["core"])
            trie = build_trie(owners)
            for m in members:
                if m["asks"]:
                    core = m["core"]
                    out.update((group, kind, core, other) for rest, _ in search(trie, m["rest"], 1) for other in owners[rest] if other != core)
        yield pd.DataFrame(sorted(out), columns=["group_id", "kind", "core", "other"])


def trie_join(cores: DataFrame, shard_names: int = SHARD_NAMES) -> DataFrame:
    """(group_id, kind, core, other), both ways: distinct cores of which forms are within one edit in the same
    group and kind.

    cores has group_id, kind and core, and may have form, a spelling that is searched with in place of the core
    itself. A form of several words is found in any order of them. Each shard is one row of its cores, so that
    tasks get many shards at once; one of more than shard_names cores is split on both sides, into tries and into
    blocks of what is searched for, and each block meets each trie.
    """
    form = F.col("form") if "form" in cores.columns else F.col("core").alias("form")
    distinct = cores.select("group_id", "kind", "core", form).distinct()
    keyed = cut_lineage(distinct.select("group_id", "kind", "core", F.explode(_sharded("form")).alias("s")).select("group_id", "kind", "core", "s.*"))
    key = ["group_id", "kind", "shard"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 AND asked").select(*key, F.ceil(F.col("n") / shard_names).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("core", "rest"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.array(F.struct(F.col("own").alias("trie"), i.alias("block")), F.struct(i.alias("trie"), F.col("own").alias("block"))))
    spread = keyed.join(sizes, key).withColumn("own", own).withColumn("cell", F.explode(F.array_distinct(F.flatten(cells))))
    member = F.struct("core", "rest", (F.col("cell.trie") == F.col("own")).alias("entry"), (F.col("asks") & (F.col("cell.block") == F.col("own"))).alias("asks"))
    shards = spread.groupBy(*key, "cell").agg(F.collect_list(member).alias("members"))  # at most about twice shard_names
    found = shards.select("group_id", "kind", "members").mapInPandas(_search_shards, "group_id string, kind string, core string, other string")
    both = F.explode(F.array(F.struct("core", "other"), F.struct(F.col("other").alias("core"), F.col("core").alias("other"))))
    return found.select("group_id", "kind", both.alias("p")).select("group_id", "kind", "p.*").distinct()


@F.pandas_udf(NAME)
def parsed(name: pd.Series, entity_type: pd.Series) -> pd.DataFrame:
    found = [parse_name(n, t) for n, t in zip(name, entity_type, strict=True)]
    rows = [(f[0], f[1], sounded(f[2]), folded(f[2]), f[2]) if f else (None,) * 5 for f in found]
    return pd.DataFrame(rows, columns=NAME.names)


_SEP = "\u001f"


def near_cores(named: DataFrame) -> DataFrame:
    """(group_id, kind, core, other): cores of which forms as sounded, as folded only, or in plain letters are within one edit.

    Folding letter by letter brings no two words apart, but where several letters become one, an edit that
    makes or breaks them counts more than once, and is one edit in another form.
    """
    rows = named.select("group_id", "kind", "core", "folded", "plain").distinct()
    return trie_join(rows.select("group_id", "kind", "core", F.explode(F.array_distinct(F.array("core", "folded", "plain"))).alias("form")))


def name_groups(entities: DataFrame) -> DataFrame:
    """(group_id, cluster, uuid): entities of one workspace whose names denote the same bearer.

    Full names are linked when their parts are equal and their cores within one edit, and what is linked
    through others counts as linked; given names that are in no list may differ by one edit too. A surname alone, one with an initial, or an organisation without line
    of business joins the bearer it fits; if it fits several, none. Null, blank and stand-in names, names
    of other things and null groups are linked to nothing; of a redelivered record one copy counts.
    """
    records = distinct_records(entities, "name", "entity_type", "group_id").where("group_id IS NOT NULL")
    named = records.select("uuid", "group_id", parsed("name", "entity_type").alias("n")).where("n.kind IS NOT NULL").select("uuid", "group_id", "n.*")
    named = cut_lineage(named.withColumn("sure", ~F.endswith("kind", F.lit("?"))).withColumn("kind", F.rtrim("kind", F.lit("?"))))
    keys = named.groupBy("group_id", "kind", "part", "core").agg(F.max("sure").alias("sure"))
    keys = cut_lineage(keys.withColumn("key", F.concat_ws(_SEP, "group_id", "kind", "part", "core")))
    near = cut_lineage(near_cores(named))
    full = keys.where("part <> '' AND NOT startswith(part, ':') AND NOT contains(part, '/')")
    partial = keys.join(full.select("key"), "key", "left_anti")
    a, b = full.select("group_id", "kind", "core", F.col("part").alias("p"), F.col("key").alias("a")), full.select("group_id", "kind", F.col("core").alias("other"), F.col("part").alias("q"), F.col("key").alias("b"))
    unlisted = F.startswith("p", F.lit("~")) & F.startswith("q", F.lit("~")) & (F.least(F.length("p"), F.length("q")) > UNLISTED_LETTERS)
    alike = (F.col("p") == F.col("q")) | (unlisted & (F.levenshtein("p", "q") <= 1))
    self_near = full.select("group_id", "kind", "core", F.col("core").alias("other")).where("startswith(part, '~')").distinct()
    beside = a.join(near.unionByName(self_near), ["group_id", "kind", "core"]).join(b, ["group_id", "kind", "other"]).where(alike & F.expr("a < b"))
    linked = connected_groups(beside.select("a", "b"))
    clusters = full.join(linked.withColumnRenamed("uuid", "key"), "key", "left").withColumn("cluster", F.coalesce("group_uuid", "key")).drop("group_uuid")
    # Capitalised words that no surer name of the workspace is like are no person.
    clusters = cut_lineage(clusters)
    clusters = clusters.join(clusters.where("sure").select("cluster").distinct(), "cluster", "left_semi")
    same = partial.select("group_id", "kind", "core", F.col("core").alias("other"), "part", "key", F.lit(0).alias("edits"))
    close = partial.join(near, ["group_id", "kind", "core"]).select("group_id", "kind", "core", "other", "part", "key", F.lit(1).alias("edits"))
    bearers = clusters.select("group_id", "kind", F.col("core").alias("other"), F.ltrim("part", F.lit("~")).alias("whole"), "cluster")
    fits = (F.col("part") == "") | F.startswith(F.col("whole"), F.substring("part", 2, 1)) & F.startswith(F.col("part"), F.lit(":"))
    fits = fits | F.array_contains(F.split("part", "/"), F.col("whole"))
    options = same.unionByName(close).join(bearers, ["group_id", "kind", "other"]).where(fits)
    least = Window.partitionBy("key")
    best = options.withColumn("_least", F.min("edits").over(least)).where("edits = _least").groupBy("key").agg(F.count_distinct("cluster").alias("n"), F.min("cluster").alias("cluster"))
    joined = best.where("n = 1").select("key", "cluster")
    # Partial names that fit no full one are one bearer if they do not differ in their parts.
    alone = partial.join(best.select("key"), "key", "left_anti")
    parts = alone.groupBy("group_id", "kind", "core").agg(F.count_distinct(F.when(F.col("part") != "", F.col("part"))).alias("n"), F.min("key").alias("cluster"))
    own = alone.join(parts.where("n <= 1").select("group_id", "kind", "core", "cluster"), ["group_id", "kind", "core"]).select("key", "cluster")
    all_keys = clusters.select("key", "cluster").unionByName(joined).unionByName(own)
    by_key = keys.join(all_keys, "key").select("group_id", "kind", "part", "core", "cluster")
    return named.join(by_key, ["group_id", "kind", "part", "core"]).select("group_id", "cluster", "uuid")


def name_pairs(entities: DataFrame) -> DataFrame:
    """(uuid_a, uuid_b): every pair within a set of spellings, the smaller uuid first. A set of more than
    CLASS_BLOCK spellings is paired block by block."""
    groups = cut_lineage(name_groups(entities))
    key = ["group_id", "cluster"]
    blocks = groups.groupBy(*key).agg(F.ceil(F.count("*") / CLASS_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    own = groups.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("uuid"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = own.select(*key, F.col("uuid").alias("uuid_a"), F.col("block").alias("x"), others.alias("y"))
    b = own.select(*key, F.col("uuid").alias("uuid_b"), F.col("block").alias("y"), others.alias("x"))
    return a.join(b, [*key, "x", "y"]).where("uuid_a < uuid_b").select("uuid_a", "uuid_b")
