"""Repair of text from scanned pages: page furniture, words cut in two, misread words, reflow.

Vocabulary, word pairs and the model of name spelling are counted over all episodes. Candidates for an unknown
word come from tries over the vocabulary: all words within one edit, by a Levenshtein automaton, and all that
up to two of the confusions of a reader of scans make of it. They are ranked by what the edits cost, by
frequency and by the neighbouring words; names that are in no vocabulary are judged by how much likelier
their letters become.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.automata import END, build_trie, search
from loomgraph.session import cut_lineage, distinct_records

COMMON_WORDS = 20_000  # the most frequent words, known to every task without a join
SHARD_WORDS = 20_000  # vocabulary words of one trie, and words searched for in it, from which on a shard is split
LINES_A_FORM, LINE_RATE = 3, 1e-5  # repeats, and repeats for each scan, that make a title-like line a running head
CLEAN_SHARE = 0.02  # a word of clean episodes is known unless scans have it more than 1 / CLEAN_SHARE times as often
SCANS_A_WORD = 3  # scans from which on a word that no clean episode has may be known
ENTRY_RATE = 0.01  # share of the scans that have a word from which on it is a candidate without clean episodes
MORE_FREQUENT = 5  # a candidate is so many times as frequent as the word
NAME_RATE = 0.005  # share of the clean episodes up to which a capitalised word may be a name
# Log-likelihoods: of one and two confusions, and of another edit, which two known neighbours must support.
COSTS = {1: -4.0, 2: -8.0, 3: -10.0}
MISREAD_PRIOR = -5.3  # log of the share of letters that are misread

# What is read for what. The printed letters come first.
CONFUSIONS = (
    ("e", "c"), ("a", "à"), ("t", "†"), ("i", "l"), ("i", "1"), ("i", "!"), ("o", "0"), ("n", "ri"), ("l", "1"), ("l", "|"), ("d", "cl"), ("s", "5"),
    ("s", "$"), ("u", "ii"), ("g", "9"), ("h", "b"), ("h", "li"), ("m", "rn"), ("b", "6"), ("b", "8"), ("w", "vv"), ("rn", "m"), ("fi", "ﬁ"), ("fl", "ﬂ"),
    ("cl", "d"), ("z", "2"), ("c", "e"), ("q", "9"), ("e", "é"), ("o", "ö"), ("u", "ü"), ("i", "í"),
)
_BY_READ: dict[str, list[tuple[str, str]]] = {}
for _printed, _read in CONFUSIONS:
    _BY_READ.setdefault(_read[0], []).append((_read, _printed))
# Signs and pairs that no word has, so that a word with one is misread.
_FOREIGN = re.compile(r"[†|àﬁﬂ$]|ii|vv|(?<=[^\W\d_])[0-9](?![0-9])|[0-9](?=[^\W\d_]{2})")
_HYPHENS = "-‐‑­¬⁃"
_TOKEN = re.compile(r"[^\s.,;:?\"“”‘’()\[\]{}<>/…—–]+")
_PAGE_WORDS = ("page", "seite", "p", "pag", "pagina", "página", "s", "pg", "blatt", "folio")
_NUMBER = r"(?:[0-9oOlI|]{1,5}|[ivxlcIVXLC]{1,7})"
_PAGE_LINE = re.compile(rf"[\W_]*(?:([^\W\d]{{1,7}})\.?\s*)?({_NUMBER})(?:\s*(?:/|of|von|de)\s*{_NUMBER})?\s*[-—–\])~*|]*")
_ROMAN = re.compile(r"(?=[mdclxvi])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})")
SCAN_SOURCE = r"(?i)^scans?/"


def read_as(text: str) -> str:
    """A form that a text and its misreadings have in common."""
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = text.translate(str.maketrans("†0156892|!$", "tolsbbgzlls"))
    for read, printed in (("vv", "w"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h")):
        text = text.replace(read, printed)
    return text.translate(str.maketrans("eihc", "clbc")).replace("cl", "d")


def is_page_number(line: str) -> bool:
    if _ROMAN.fullmatch(line.strip(" \t\f-—–[]()~*|.").lower() or "-") and not line.strip().endswith("."):
        return True
    m = _PAGE_LINE.fullmatch(line.strip())
    if not m or line.strip().endswith("."):
        return False
    word = m[1]
    if word is None:
        return any(c.isdigit() for c in m[2])
    return read_as(word) in _PAGE_READ and (any(c.isdigit() for c in m[2]) or len(m[2]) <= 2 or m[2].islower())


_PAGE_READ = {read_as(w) for w in _PAGE_WORDS}


def head_forms(line: str) -> list[str]:
    """Forms under which a title-like line is counted: itself, and with any first word; no page number."""
    text = re.sub(r"^\W*[0-9oOlI|]{1,5}\s{2,}|\s{2,}[0-9oOlI|]{1,5}\W*$", "", line.strip()).strip()
    if not 6 <= len(text) <= 70 or text[-1] in ".,;:!?'\"”" + _HYPHENS:
        return []
    words = re.findall(r"[^\s]+", text)
    long = [w for w in words if sum(c.isalpha() for c in w) >= 4]
    if len(words) < 2 or not long or not all(w[0].isupper() or not w[0].isalpha() for w in long) or not words[0][0].isupper():
        return []
    if sum(w[0].islower() for w in words) > 1:
        return []
    plain = [re.sub(r"\d+", "#", w) if re.fullmatch(r"\W*\d+\W*", w) else read_as(w) for w in words]
    return ["=" + " ".join(plain), "*" + " ".join(plain[1:])]


def looks_scanned(text: str) -> bool:
    """For episodes without a source: lines of one width that break within sentences."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 4 or any(re.match(r"[^\W\d]+:|[#>*|<{\\[]", x) for x in lines):
        return False
    wraps = sum(1 for a, b in zip(lines, lines[1:], strict=False) if 35 <= len(a) <= 90 and a[-1] not in ".!?:" and b[:1].islower())
    return wraps >= 0.4 * len(lines)


def body_words(lines: list[str], furniture: set[int]) -> list[tuple[int, int, str, str]]:
    """(line, other line, kind, word): words of the body, and for a line that ends in a hyphen the joined
    word ('join') and the compound ('compound') of its last and the next body line's first piece."""
    body = [i for i, x in enumerate(lines) if x.strip() and i not in furniture]
    out: list[tuple[int, int, str, str]] = []
    skip_first = False
    for k, i in enumerate(body):
        tokens = [w.strip("'’‘*_") for w in _TOKEN.findall(lines[i])]
        tokens = [w for w in tokens if w]
        if skip_first:
            tokens = tokens[1:]
        skip_first = False
        text = lines[i].rstrip()
        if tokens and text[-1] in _HYPHENS and tokens[-1][-1:] in _HYPHENS and k + 1 < len(body):
            piece = tokens.pop().rstrip(_HYPHENS)
            after = _TOKEN.findall(lines[body[k + 1]])
            if piece and after:
                rest = after[0].strip("'’‘*_")
                soft = text[-1] not in "-‐‑"
                out.append((i, body[k + 1], "join!" if soft else "join", piece + "\t" + rest))
                skip_first = True
        out += [(i, i, "word", w) for w in tokens]
    return out


def _plain_word(word: str) -> bool:
    return word.replace("-", "").replace("'", "").isalpha()


def confusable(root: dict, word: str, most: int = 2) -> list[tuple[str, int, int]]:
    """(word of the trie, confusions, place of the first) of all that can be read as word with 1 to most of them."""
    out, stack = [], [(root, 0, 0, -1)]
    n = len(word)
    while stack:
        node, at, cost, place = stack.pop()
        if at == n:
            if cost and END in node:
                out.append((node[END], cost, place))
            continue
        step = node.get(word[at])
        if step is not None:
            stack.append((step, at + 1, cost, place))
        if cost < most:
            for read, printed in _BY_READ.get(word[at], ()):
                if word.startswith(read, at):
                    to: dict | None = node
                    for c in printed:
                        to = to.get(c)
                        if to is None:
                            break
                    if to is not None:
                        stack.append((to, at + len(read), cost + 1, at if place < 0 else place))
    return out


def candidates(root: dict, word: str) -> list[tuple[str, int, int]]:
    """(word of the trie, tier, first misread letter): by one or two confusions, or in tier 3 by another single edit."""
    best: dict[str, tuple[int, int]] = {}
    for found, cost, place in confusable(root, word):
        best[found] = min(best.get(found, (9, 0)), (cost, place))
    for found, edits in search(root, word, 1):
        if edits and found not in best:
            same = 0
            while same < min(len(found), len(word)) and found[same] == word[same]:
                same += 1
            best[found] = (3, min(same, len(word) - 1))
    return [(found, tier, place) for found, (tier, place) in best.items()]


SHORT = 7


def entry_keys(word: str) -> list[str]:
    """Shards that hold a vocabulary word: by its first and its last three letters, if short also by one."""
    keys = [f"<{word[:3]}", f">{word[-3:]}"]
    return [*keys, f"({word[:1]}", f"){word[-1:]}"] if len(word) <= SHORT else keys


def query_keys(word: str) -> list[str]:
    """Shards that together hold all candidates of a word.

    A single edit leaves the first or the last three letters of a word of seven or more as they are, of a
    shorter one the first or the last letter. Confusions may touch both, so that all beginnings they could have made are
    asked for.
    """
    keys = {f"<{word[:3]}", f">{word[-3:]}"} if len(word) >= SHORT else {f"({word[:1]}", f"){word[-1:]}", f"<{word[:3]}"}
    stack = [("", 0, 0)]
    while stack:
        printed, at, cost = stack.pop()
        if len(printed) >= 3 or at >= len(word):
            keys.add(f"<{printed[:3]}")
            continue
        stack.append((printed + word[at], at + 1, cost))
        if cost < 2:
            stack += [(printed + p, at + len(read), cost + 1) for read, p in _BY_READ.get(word[at], ()) if word.startswith(read, at)]
    return sorted(keys)


class NameModel:
    """Log-likelihood of the letters of a name, by trigrams."""

    def __init__(self, trigrams: dict[str, int]) -> None:
        self.three = trigrams
        self.two: dict[str, int] = {}
        for gram, n in trigrams.items():
            self.two[gram[:2]] = self.two.get(gram[:2], 0) + n

    def score(self, word: str) -> float:
        text = "^^" + word + "$"
        return sum(math.log((self.three.get(text[i : i + 3], 0) + 0.1) / (self.two.get(text[i : i + 2], 0) + 3.0)) for i in range(len(text) - 2))

    def misread(self, word: str) -> int:
        """Place of the confusion whose undoing makes the name likelier than the prior of misreading, or -1."""
        own, best, place = self.score(word), 0.0, -1
        for at in range(len(word)):
            for read, printed in _BY_READ.get(word[at], ()):
                if word.startswith(read, at):
                    gain = self.score(word[:at] + printed + word[at + len(read) :]) - own + MISREAD_PRIOR
                    if gain > best:
                        best, place = gain, at
        return place


def scanned_episodes(episodes: DataFrame) -> DataFrame:
    """(uuid, content, source, scanned) of distinct records with content."""
    records = distinct_records(episodes, "content", "source").where("content IS NOT NULL")

    @F.pandas_udf("boolean")
    def guess(texts: pd.Series) -> pd.Series:
        return texts.map(looks_scanned)

    source = F.trim(F.coalesce("source", F.lit("")))
    return records.withColumn("scanned", F.when(source != "", source.rlike(SCAN_SOURCE)).otherwise(guess("content")))


def running_heads(scans: DataFrame) -> DataFrame:
    """(uuid, line_no): title-like lines that are repeated, over all scans or in one document."""

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (uuid, source, i, form)
                for uuid, content, source in zip(pdf.uuid, pdf.content, pdf.source, strict=True)
                for i, line in enumerate(content.split("\n"))
                if not is_page_number(line)
                for form in head_forms(line)
            ]
            yield pd.DataFrame(rows, columns=["uuid", "source", "line_no", "form"])

    found = cut_lineage(scans.select("uuid", "content", "source").mapInPandas(candidates, "uuid string, source string, line_no int, form string"))
    repeats = max(LINES_A_FORM, round(LINE_RATE * scans.count()))
    least = F.when(F.startswith("form", F.lit("*")), repeats + 2).otherwise(repeats)
    everywhere = found.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("form")
    within = found.where("startswith(form, '=') AND source <> ''").groupBy("form", "source").agg(F.count("*").alias("n")).where("n >= 2").select("form", "source")
    named = found.where("form <> '*'")
    return (
        named.join(everywhere, "form", "left_semi").select("uuid", "line_no")
        .unionByName(named.join(within, ["form", "source"], "left_semi").select("uuid", "line_no"))
        .distinct()
    )


def vocabulary(records: DataFrame) -> DataFrame:
    """(word, clean, scan, capital): in how many clean and scanned episodes a word stands, how often capitalised."""
    each = records.select("scanned", F.explode(F.array_distinct(_tokens("content"))).alias("raw"))
    forms = each.groupBy("scanned", "raw").agg(F.count("*").alias("n"))
    raw = F.regexp_replace("raw", r"^['*_]+|['*_]+$", "")
    words = forms.select("scanned", "n", F.lower(raw).alias("word"), (raw != F.lower(raw)).alias("capital")).where(F.col("word").rlike(r"^\p{L}+(?:['-]\p{L}+)*$"))
    return words.groupBy("word").agg(
        *[F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name) for name, which in (("clean", ~F.col("scanned")), ("scan", F.col("scanned")), ("capital", F.col("capital")))]
    )


_SPLITTERS = " \t\n\x0b\f\r.,;:?!\"“”‘’()[]{}<>/…—–"


def _tokens(text: str | Column) -> Column:
    return F.split(F.translate(text, _SPLITTERS, " " * len(_SPLITTERS)), " +")


class Sizes:
    """How many clean and scanned episodes there are, by which counts of words are measured."""

    def __init__(self, records: DataFrame) -> None:
        row = records.agg(F.count_if(~F.col("scanned")).alias("clean"), F.count_if("scanned").alias("scans")).first()
        self.clean, self.scans = max(1, row.clean), max(1, row.scans)

    def is_clean(self) -> str:
        return f"clean >= 2 AND clean * {self.scans}D >= {CLEAN_SHARE} * scan * {self.clean}D"


def _search_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: set[tuple] = set()
        for words in pdf.members:
            trie = build_trie(m["word"] for m in words if m["entry"])
            for m in words:
                if not m["entry"]:
                    rows.update((m["word"], *found) for found in candidates(trie, m["word"]))
        yield pd.DataFrame(sorted(rows), columns=["word", "fix", "tier", "place"])


def all_candidates(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, fix, tier, place): the candidates of each word among those of vocab.

    Both sides meet in shards by their ends. A shard of more than SHARD_WORDS words is split into several
    tries and into blocks of words asked for, and each block meets each trie.
    """
    keys_of = lambda keys: F.pandas_udf(lambda texts: texts.map(keys), "array<string>")
    entries = vocab.select("word", F.lit(True).alias("entry"), F.explode(keys_of(entry_keys)("word")).alias("shard"))
    queries = words.select("word", F.lit(False).alias("entry"), F.explode(keys_of(query_keys)("word")).alias("shard"))
    both = cut_lineage(entries.unionByName(queries))
    counts = both.groupBy("shard").agg(F.count_if("entry").alias("e"), F.count_if(~F.col("entry")).alias("q")).where("e > 0 AND q > 0")
    sizes = counts.select("shard", F.ceil(F.col("e") / SHARD_WORDS).cast("int").alias("tries"), F.ceil(F.col("q") / SHARD_WORDS).cast("int").alias("blocks"))
    mine = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    cells = F.when(
        F.col("entry"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(mine("tries").alias("trie"), b.alias("block")))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("tries") - 1), lambda t: F.struct(t.alias("trie"), mine("blocks").alias("block"))))
    spread = both.join(sizes, "shard").select("shard", "word", "entry", F.explode(cells).alias("cell"))
    shards = spread.groupBy("shard", "cell").agg(F.collect_list(F.struct("word", "entry")).alias("members"))  # at most about twice SHARD_WORDS
    return shards.select("members").mapInPandas(_search_shards, "word string, fix string, tier int, place int").distinct()


def supported(options: DataFrame, contexts: DataFrame, records: DataFrame) -> DataFrame:
    """(word, fix, left, right): in how many episodes a candidate stands beside a neighbour that the word has in a scan.

    contexts has (word, before, after). Pairs of words are counted over all records, by their hash. Those that are
    asked for have a table of known size, so that Spark only sends it to the texts while it is small.
    """
    pair = lambda a, b: F.xxhash64(a, b)
    sides = F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.when(F.col("before").isNotNull(), pair("before", "fix")).alias("pair")),
        F.struct(F.lit(False).alias("left"), F.when(F.col("after").isNotNull(), pair("fix", "after")).alias("pair")),
    ))
    asked = options.select("word", "fix").join(contexts, "word").select("word", "fix", sides.alias("s")).where("s.pair IS NOT NULL")
    asked = cut_lineage(asked.select("word", "fix", "s.left", "s.pair").distinct())
    wanted = cut_lineage(asked.select("pair").distinct())
    words = records.select(_tokens(F.lower("content")).alias("t")).where(F.size("t") > 1)
    seen = words.select(F.explode(F.array_distinct(F.zip_with("t", F.slice("t", 2, F.size("t")), pair))).alias("pair"))
    counts = seen.join(wanted, "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("n"))
    return asked.join(counts, "pair").groupBy("word", "fix").agg(
        F.sum(F.when(F.col("left"), F.col("n")).otherwise(0)).alias("left"), F.sum(F.when(F.col("left"), 0).otherwise(F.col("n"))).alias("right")
    )


def judge_words(asked: DataFrame, contexts: DataFrame, counts: DataFrame, records: DataFrame, sizes: Sizes, names: dict[str, int]) -> DataFrame:
    """(word, known, fix, place): for distinct words in lower case, flagged cap where only seen capitalised.

    The vocabulary has the words of at least two clean episodes, unless scans have them far more often, and
    those of three scans that are no misreading of a word MORE_FREQUENT times as frequent. place is the first misread
    letter, -1 for none. An edit that is no confusion counts only for a word of one scan, within it, and where the
    candidate is known beside the words before and after.
    """
    clean = counts.where(sizes.is_clean())
    more = counts.where(f"NOT ({sizes.is_clean()}) AND scan >= {SCANS_A_WORD}")
    open_words = asked.join(clean.select("word"), "word", "left_anti")
    own = cut_lineage(open_words.join(more.select("word", (F.col("clean") + F.col("scan")).alias("own")), "word", "left").withColumn("own", F.coalesce("own", F.lit(0))))
    frequent = more.where(F.col("scan") >= F.lit(max(float(SCANS_A_WORD), ENTRY_RATE * sizes.scans)))
    vocab = clean.unionByName(frequent).select("word", (F.col("clean") + F.col("scan")).alias("n"))
    found = all_candidates(own.select("word"), vocab).join(vocab.withColumnRenamed("word", "fix"), "fix").join(own.select("word", "own"), "word")
    inner = (F.col("place") > 0) & (F.length("fix") == F.length("word")) & (F.col("own") == 0) & (F.length("word") >= 4) & F.expr("right(fix, 1) = right(word, 1)")
    options = cut_lineage(found.where((F.col("n") > MORE_FREQUENT * F.col("own")) & ((F.col("tier") < 3) | inner)))
    beside = supported(options, contexts, records)
    cost = F.element_at(F.create_map(*[F.lit(x) for pair in COSTS.items() for x in pair]), F.col("tier"))
    ranked = options.join(beside, ["word", "fix"], "left").fillna(0, ["left", "right"]).where("tier < 3 OR (left > 0 AND right > 0)")
    score = cost + F.log("n") + F.log1p("left") + F.log1p("right")
    best = ranked.groupBy("word").agg(F.max_by(F.struct("fix", "place"), F.struct(F.round(score, 9), "fix")).alias("b")).select("word", "b.fix", "b.place")

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = NameModel(names)
        for pdf in batches:
            fix, place = pdf.fix.tolist(), pdf.place.fillna(-1).astype(int).tolist()
            for i, (word, cap, own, known) in enumerate(zip(pdf.word, pdf.cap, pdf.own, pdf.fix.notna(), strict=True)):
                if known or own >= SCANS_A_WORD:
                    continue
                if m := _FOREIGN.search(word):
                    if any(c.isalpha() for c in word) and len(word) > 2:
                        place[i] = m.start()
                elif cap and word.isalpha() and word.isascii():
                    place[i] = model.misread(word)
            yield pd.DataFrame({"word": pdf.word, "known": (pdf.own >= SCANS_A_WORD) & pdf.fix.isna(), "fix": fix, "place": place})

    rest = own.join(best, "word", "left").select("word", "cap", "own", "fix", "place")
    judged_rest = rest.mapInPandas(spell, "word string, known boolean, fix string, place int")
    known = asked.join(clean.select("word"), "word", "left_semi")
    return judged_rest.unionByName(known.select("word", F.lit(True).alias("known"), F.lit(None).cast("string").alias("fix"), F.lit(-1).alias("place")))


def name_trigrams(counts: DataFrame, sizes: Sizes) -> dict[str, int]:
    """Letter trigrams of words that clean episodes only have capitalised; at most 28 ** 3 of them."""
    text = F.concat(F.lit("^^"), F.col("word"), F.lit("$"))
    names = counts.where(f"clean >= 1 AND capital >= clean AND clean <= {NAME_RATE * sizes.clean} + 1").where(F.col("word").rlike("^[a-z]{4,}$"))
    grams = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).alias("g"))
    return {r.g: r.n for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()}


def scan_findings(episodes: DataFrame) -> DataFrame:
    """(uuid, line_no, kind, at, word, fix): what is wrong in the lines of scanned episodes.

    kind is 'running_head', 'page_number', 'broken_word' or 'misread'; word and fix tell the repair of the
    last two. An episode is scanned if its source says so, or if it has no source and its lines are broken
    as those of a page. Null and empty contents have no row; a redelivered record counts once.
    """
    records = cut_lineage(scanned_episodes(episodes))
    scans = records.where("scanned").select("uuid", "content", "source")
    heads = cut_lineage(running_heads(scans))
    counts = cut_lineage(vocabulary(records))
    sizes = Sizes(records)
    names = name_trigrams(counts, sizes)
    common = {r.word for r in counts.where(sizes.is_clean()).orderBy(F.desc("clean"), "word").limit(COMMON_WORDS).select("word").collect()}
    sent = scans.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = sent.value
        columns = ["uuid", "line_no", "other", "kind", "word", "cap", "raw", "before", "after"]
        for pdf in batches:
            rows = []
            for uuid, content, own in zip(pdf.uuid, pdf.content, pdf.heads, strict=True):
                lines = content.split("\n")
                top = set() if own is None else {int(i) for i in own}
                pages = {i for i, x in enumerate(lines) if x.strip() and i not in top and is_page_number(x)}
                rows += [(uuid, i, i, "page_number", "", False, "", None, None) for i in sorted(pages)]
                rows += [(uuid, i, i, "running_head", "", False, "", None, None) for i in sorted(top)]
                body = body_words(lines, top | pages)
                plain = [w.lower().strip(_HYPHENS) if kind == "word" else None for _, _, kind, w in body]
                for (i, j, kind, word), before, after in zip(body, [None, *plain], [*plain[1:], None], strict=False):
                    if kind == "word":
                        low = word.lower().strip(_HYPHENS)
                        parts = [low] if low in common or not re.search(f"[{_HYPHENS}]", low) else re.split(f"[{_HYPHENS}]", low)
                        for part in parts:
                            if part and part not in common and not part.isdigit() and len(part) > 1:
                                rows.append((uuid, i, i, "word", part, word[:1].isupper(), word, before, after))
                    else:
                        a, b = word.lower().split("\t")
                        b = re.split(f"[{_HYPHENS}]", b)[0] if kind == "join" and "-" in b.strip(_HYPHENS) else b
                        cap = word[:1].isupper()
                        for part, form in ((a + b, kind), (f"{a}-{b}", "compound"), (a, "first"), (b, "second")):
                            rows.append((uuid, i, j, form, part, cap, word, None, None))
            yield pd.DataFrame(rows, columns=columns)

    schema = "uuid string, line_no int, other int, kind string, word string, cap boolean, raw string, before string, after string"
    lists = heads.groupBy("uuid").agg(F.collect_set("line_no").alias("heads"))  # bounded by the lines of one episode
    found = cut_lineage(scans.join(lists, "uuid", "left").select("uuid", "content", "heads").mapInPandas(read, schema))
    asked = cut_lineage(found.where("word <> ''").groupBy("word").agg(F.min("cap").alias("cap")))
    contexts = found.where("kind = 'word' AND (before IS NOT NULL OR after IS NOT NULL)").select("word", "before", "after").distinct()
    judged = cut_lineage(judge_words(asked, contexts, counts, records, sizes, names))
    plain = found.where("kind IN ('page_number', 'running_head')").select("uuid", "line_no", "kind", F.lit("").alias("word"), F.lit(None).cast("string").alias("fix"))
    with_verdict = found.where("word <> ''").join(judged, "word", "left")
    wrong = with_verdict.where("kind = 'word' AND NOT known AND place >= 0").select("uuid", "line_no", F.lit("misread").alias("kind"), F.col("raw").alias("word"), "fix")
    breaks = with_verdict.where("kind <> 'word'").groupBy("uuid", "line_no", "other", "raw").agg(
        *[
            F.max(F.when(F.col("kind").isin(*kinds), F.struct("known", "fix", "place", "word"))).alias(name)
            for name, kinds in (("joined", ["join", "join!"]), ("compound", ["compound"]), ("first", ["first"]), ("second", ["second"]))
        ],
        F.max(F.col("kind") == "join!").alias("soft"),
    )
    ok = lambda c: F.col(f"{c}.known") | F.col(f"{c}.fix").isNotNull()
    broken = F.col("soft") | F.col("joined.known") | (F.col("joined.fix").isNotNull() & ~ok("compound")) | ~(ok("compound") | (ok("first") & ok("second")))
    breaks = breaks.withColumn("broken", F.coalesce(broken, F.lit(True)))
    cut = breaks.where("broken").select("uuid", "line_no", F.lit("broken_word").alias("kind"), F.col("raw").alias("word"), F.coalesce("joined.fix", "joined.word").alias("fix"))
    at = F.length(F.split("raw", "\t")[0])
    inside = breaks.where("broken AND NOT joined.known AND joined.place >= 0").select(
        "uuid", F.when(F.col("joined.place") < at, F.col("line_no")).otherwise(F.col("other")).alias("line_no"), F.lit("misread").alias("kind"), F.col("raw").alias("word"), "joined.fix"
    )
    parts = breaks.where("NOT broken").select("uuid", F.explode(F.array(F.struct(F.col("line_no").alias("l"), F.col("first").alias("p")), F.struct(F.col("other").alias("l"), F.col("second").alias("p")))).alias("x"))
    part_wrong = parts.where("NOT x.p.known AND x.p.place >= 0").select("uuid", F.col("x.l").alias("line_no"), F.lit("misread").alias("kind"), F.col("x.p.word").alias("word"), F.col("x.p.fix").alias("fix"))
    whole = breaks.where("NOT broken AND NOT compound.known AND compound.place >= 0").select(
        "uuid", F.when(F.col("compound.place") < at, F.col("line_no")).otherwise(F.col("other")).alias("line_no"), F.lit("misread").alias("kind"), F.col("raw").alias("word"), F.lit(None).cast("string").alias("fix")
    )
    out = plain
    for more in (wrong, cut, inside, part_wrong, whole):
        out = out.unionByName(more)
    return out


def scan_lines(episodes: DataFrame) -> DataFrame:
    """(uuid, line_no, kind), once each."""
    return scan_findings(episodes).select("uuid", "line_no", "kind").distinct()


def _like(word: str, fix: str) -> str:
    return fix.upper() if word.isupper() and len(word) > 1 else fix[:1].upper() + fix[1:] if word[:1].isupper() else fix


def reflow(lines: list[str], drop: set[int], fixes: dict[int, list[tuple[str, str]]], joins: dict[int, tuple[str, str]]) -> str:
    """Paragraphs of the body: furniture gone, words repaired and joined, lines run on to the paragraph's end."""
    paragraphs: list[list[str]] = [[]]
    carried = ""
    for i, line in enumerate(lines):
        if i in drop:
            continue
        if not line.strip():
            if paragraphs[-1] and not carried and paragraphs[-1][-1].rstrip()[-1:] in ".!?:\"'”":
                paragraphs.append([])
            continue
        text = line.strip()
        if carried:
            text = carried + re.sub(r"^\S+?(?=[\s.,;:!?)]|$)", "", text, count=1)
            carried = ""
        for word, fix in fixes.get(i, ()):
            text = re.sub(rf"(?<!\w){re.escape(word)}(?!\w)", lambda m, fix=fix: _like(m.group(), fix), text)
        if i in joins:
            piece, whole = joins[i]
            carried = _like(piece, whole)
            text = text[: text.rfind(piece)].rstrip() if piece in text else text
        if text:
            paragraphs[-1].append(text)
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def repaired_scans(episodes: DataFrame) -> DataFrame:
    """(uuid, text): scanned episodes as continuous paragraphs."""
    found = scan_findings(episodes).groupBy("uuid").agg(F.collect_list(F.struct("line_no", "kind", "word", "fix")).alias("found"))
    scans = scanned_episodes(episodes).where("scanned").select("uuid", "content")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for content, found in zip(pdf.content, pdf.found, strict=True):
                drop, fixes, joins = set(), {}, {}
                for f in () if found is None else found:
                    if f["kind"] in ("running_head", "page_number"):
                        drop.add(f["line_no"])
                    elif f["kind"] == "broken_word":
                        joins[f["line_no"]] = (f["word"].split("\t")[0], f["fix"] or f["word"].replace("\t", ""))
                    elif f["fix"] and "\t" not in f["word"]:
                        fixes.setdefault(f["line_no"], []).append((f["word"], f["fix"]))
                out.append(reflow(content.split("\n"), drop, fixes, joins))
            yield pd.DataFrame({"uuid": pdf.uuid, "text": out})

    return scans.join(found, "uuid", "left").mapInPandas(mend, "uuid string, text string")
