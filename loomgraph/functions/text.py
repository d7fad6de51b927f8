"""Scalar functions on text as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of a query's intent; the first keyword in the query decides.
INTENT_WORDS = {
    "WHY": ["why", "reason", "cause", "causes", "because"],
    "WHEN": ["when", "date", "time", "year", "before", "after", "since"],
    "ENTITY": ["who", "which", "person", "people", "company", "organization"],
}
# Parts of relation names that make their class, in order of precedence.
CLASS_PARTS = {
    "causal": ["CAUSE", "RESULT", "LEADS_TO", "TRIGGER", "PRODUCES"],
    "temporal": ["BORN_ON", "OCCURRED_AT", "HAPPENED_ON", "FOUNDED_ON", "DIED_ON", "AT_DATE"],
    "relational": [
        "KNOWS", "RELATED_TO", "MEMBER_OF", "PART_OF", "CONNECTED_TO", "MARRIED", "ALLIED", "OPPOS", "LOVES", "PARENT", "CHILD_OF", "COMMAND", "SERVES",
    ],
}
# How much a class of relation helps an intent.
PHI = {
    "WHAT": {"unknown": 0.0, "relational": 0.5, "causal": 0.5, "temporal": 0.5, "attributive": 0.5},
    "WHY": {"unknown": 0.0, "relational": 0.5, "causal": 1.0, "temporal": 0.3, "attributive": 0.4},
    "WHEN": {"unknown": 0.0, "relational": 0.3, "causal": 0.3, "temporal": 1.0, "attributive": 0.3},
    "ENTITY": {"unknown": 0.0, "relational": 1.0, "causal": 0.4, "temporal": 0.3, "attributive": 0.6},
}
# How an entity of a type is introduced in the text that is embedded for it.
INTRODUCTIONS = {"Person": "A person named ", "Organization": "An organization called ", "Place": "A place called ", "Product": "A product called ", "Event": "An event called "}


def ascii_lower(c: Column) -> Column:
    """Folds A to Z alone, as the entity key does."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fields(c: Column) -> Column:
    """The parts between white space, without empty ones."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct lower-case words; 0 when neither has one."""
    x, y = F.array_distinct(fields(F.lower(a))), F.array_distinct(fields(F.lower(b)))
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))


def chunk_windows(c: Column, size: int = 1500, overlap: int = 150) -> Column:
    """Windows of size code points, each beginning size - overlap after the last, up to the one that reaches the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / F.lit(step)).cast("int") * step)
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(c, i + 1, F.lit(size)))


def chunk_lines(c: Column, size: int) -> Column:
    """Whole lines gathered up to size bytes; a text of at most size code points stays whole, a longer line too."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, line: Column) -> Column:
        full = (F.octet_length(state["open"]) + F.octet_length(line) + 1 > size) & (F.octet_length(state["open"]) > 0)
        opened = F.when(full | (state["open"] == ""), line).otherwise(F.concat(state["open"], F.lit("\n"), line))
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), opened.alias("open"))

    folded = F.aggregate(F.split(c, "\n"), empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(folded)


def session_number(source: Column) -> Column:
    """The number after the last session_ up to a slash; 0 without one."""
    text = F.regexp_extract(source, r".*session_([^/]*)", 1)
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.cast("int")), F.lit(0))


def approx_tokens(c: Column) -> Column:
    return F.floor((F.octet_length(c) + 3) / 4).cast("bigint")


def temporal_tag(source: Column) -> Column:
    """[session_N] and a blank when the last part of the path is a session; else empty."""
    last = F.element_at(F.split(source, "/"), -1)
    return F.when(F.startswith(last, F.lit("session_")), F.concat(F.lit("["), last, F.lit("] "))).otherwise(F.lit(""))


def normalise_answer(c: Column) -> Column:
    """Lower case, no punctuation, articles between blanks dropped once each, single blanks; a leading article stays."""
    plain = F.regexp_replace(F.lower(c), r"\p{P}", "")
    for article in (" a ", " an ", " the "):
        plain = F.replace(plain, F.lit(article), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the words, each counted as often as both sides have it; 0 if a side has none."""
    p, g = fields(normalise_answer(prediction)), fields(normalise_answer(gold))
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(count(p, w), count(g, w)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def exact_match(prediction: Column, gold: Column) -> Column:
    return F.when(normalise_answer(prediction) == normalise_answer(gold), F.lit(1.0)).otherwise(F.lit(0.0))


def is_hypothetical(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^(?:(?:would|could|might|will) |is it (?:likely|possible))")


def query_intent(c: Column) -> Column:
    """WHY, WHEN or ENTITY by the first keyword, else WHAT."""
    words = fields(F.lower(c))
    every = [w for own in INTENT_WORDS.values() for w in own]
    first = F.get(F.filter(words, lambda w: w.isin(every)), F.lit(0))
    out = F.lit("WHAT")
    for intent, own in INTENT_WORDS.items():
        out = F.when(first.isin(own), F.lit(intent)).otherwise(out)
    return out


def edge_class(name: Column) -> Column:
    """causal before temporal before relational by parts of the name; attributive for the rest, unknown for an empty one."""
    upper = F.upper(name)
    out = F.lit("attributive")
    for kind, parts in reversed(CLASS_PARTS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(upper, F.lit(p)) for p in parts]), F.lit(kind)).otherwise(out)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(out)


def phi(intent: Column, kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, row in PHI.items() for k, v in row.items() for x in (f"{i}/{k}", v)])
    return F.coalesce(table[F.concat(intent, F.lit("/"), kind)], F.lit(0.0))


def transition(intent: Column, name: Column, similarity: Column, lambda1: float = 1.0, lambda2: float = 0.0) -> Column:
    return F.exp(lambda1 * phi(intent, edge_class(name)) + lambda2 * similarity)


def recency_decay(session: Column, most: Column) -> Column:
    """Weight of a result of one session where the newest is most; 1 where sessions do not matter."""
    return F.when((most > 1) & (session > 0), F.exp(-0.3 * (most - session) / most)).otherwise(F.lit(1.0))


def entity_embedding_text(name: Column, kind: Column, description: Column) -> Column:
    """The description, else the name introduced by its type."""
    start = F.lit("A concept called ")
    for own, text in INTRODUCTIONS.items():
        start = F.when(kind == own, F.lit(text)).otherwise(start)
    return F.coalesce(F.nullif(description, F.lit("")), F.concat(start, name))


def short_path(c: Column, most: int = 50) -> Column:
    """The last most - 3 characters behind an ellipsis where a path is longer."""
    return F.when(F.octet_length(c) > most, F.concat(F.lit("…"), F.right(c, F.lit(most - 3)))).otherwise(c)


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(suffix))).otherwise(c)


def flexible_int(c: Column) -> Column:
    """An integer from JSON text that may be an int, a float or a string of either; null for null or others."""
    plain = F.trim(F.regexp_replace(c, '^"|"$', ""))
    return F.when((c == "null") | (plain == ""), F.lit(0)).otherwise(plain.try_cast("double").cast("int"))


def flexible_string(c: Column) -> Column:
    """A string from JSON text that may be a string or a number; null for null and the empty string."""
    plain = F.regexp_replace(c, '^"|"$', "")
    return F.when((c == "null") | (plain == ""), F.lit(None).cast("string")).otherwise(plain)


# How a model begins when it refuses.
REFUSALS = ("i cannot", "i'm sorry", "i am sorry", "i'm unable", "i am unable", "cannot fulfill", "cannot process", "unable to process")


def is_refusal(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(s)) for s in REFUSALS])


def is_double_page(width: Column, height: Column) -> Column:
    return F.coalesce((height > 0) & (width / height > 1.3), F.lit(False))


def retry_delay(attempts: Column) -> Column:
    """Seconds to wait after so many failures."""
    return F.when(attempts <= 1, 5).when(attempts == 2, 15).otherwise(30)


def retry_temperature(attempts: Column) -> Column:
    return F.least(F.lit(0.3) * attempts, F.lit(0.8))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def answer_text(answer: Column, adversarial: Column | None = None, category: Column | None = None) -> Column:
    """An answer's JSON value as text, numbers as they stand; category 5 falls back to the adversarial answer."""
    plain = lambda c: F.coalesce(F.regexp_replace(F.when(c != "null", c), '^"|"$', ""), F.lit(""))
    own = plain(answer)
    if adversarial is None or category is None:
        return own
    return F.when((category == 5) & (own == ""), plain(adversarial)).otherwise(own)


# Extensions of files read as text.
TEXT_EXTENSIONS = (
    ".go", ".md", ".txt", ".yaml", ".yml", ".json", ".toml", ".sh", ".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".sql", ".env", ".proto", ".graphql", ".html", ".css", ".bib",
)
# Folders that a walk leaves out, besides those that begin with a dot.
SKIPPED_FOLDERS = ("node_modules", "vendor", "dist", "build", "__pycache__", "coverage", "testdata")


def has_text_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*TEXT_EXTENSIONS)


def in_skipped_folder(relative: Column) -> Column:
    folders = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1)
    return F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS) | (F.startswith(f, F.lit(".")) & (F.length(f) > 1)))
