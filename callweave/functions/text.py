"""Text functions for identifiers, prose and model answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.names import ANGLE_MARKERS, any_of

#: Patterns of identifiers and labels, and pairs of quotes.
NON_ALNUM = "[^a-zA-Z0-9]+"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
LABEL_WORD = r"[\p{L}\p{N}]+(?:['’.\-‐-―][\p{L}\p{N}]+)*"
LABEL_JOIN = r"(?:\s+|\s+[&/\-‐-―]\s+)"
QUOTES = ('""', "''", "``", "“”", "‘’")


def split_identifier(term: Column) -> Column:
    """Lower-case fragments of an identifier or prose: parts between non-alphanumerics, cut at camel boundaries."""
    pieces = F.flatten(F.transform(F.split(term, NON_ALNUM), lambda w: F.split(w, CAMEL)))
    return F.transform(F.filter(pieces, lambda w: w != ""), F.lower)


def method_terms(term: Column) -> Column:
    """Fragments of a method name: cut at non-alphanumerics and before a capital after a small letter or digit."""
    return F.transform(F.filter(F.split(term, "(?<=[a-z0-9])(?=[A-Z])|[^a-zA-Z0-9]+"), lambda w: w != ""), F.lower)


#: English stop words of three and more letters.
STOP_WORDS = (
    "myself our ours ourselves you your yours yourself yourselves him his himself she her hers herself its itself they them their theirs themselves what which who whom this that these those "
    "are was were been being have has had having does did doing the and but because until while for with about against between into through during before after above below from down out off over "
    "under again further then once here there when where why how all any both each few more most other some such nor not only own same than too very can will just don should now "
    "ain aren couldn didn doesn hadn hasn haven isn mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def stop_words() -> list[str]:
    return list(STOP_WORDS)


def preprocess_document(terms: Column, stops: list[str], shortest: int = 3) -> Column:
    """Fragments of all terms without markers, short words and stop words, joined by spaces."""
    clean = F.filter(terms, lambda t: ~any_of([t.contains(m) for m in ANGLE_MARKERS]))
    words = F.flatten(F.transform(clean, split_identifier))
    stop = F.array(*map(F.lit, stops))
    return F.array_join(F.filter(words, lambda w: (F.length(w) >= shortest) & ~F.array_contains(stop, w)), " ")


def normalise_prose(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def distinct_first(values: Column) -> Column:
    """Values in order without blanks and repeats, prose normalised."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalise_prose), lambda v: v != ""))


def labelled_text(categories: list[tuple[str, Column]]) -> Column:
    """``Label: v1; v2`` lines; empty categories are left out."""
    lines = [F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, "; "))) for label, values in categories]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def class_text(name: str = "className") -> Column:
    """Embedding text of a class: Class, Methods, Members, Identifiers, Comments and Messages."""
    kinds = [("Methods", "methodNames"), ("Members", "memberNames"), ("Identifiers", "identifiers"), ("Comments", "comments"), ("Messages", "literals")]
    return labelled_text([("Class", distinct_first(F.array(F.col(name)))), *((label, distinct_first(F.col(c))) for label, c in kinds)])


def term_text(*columns: str) -> Column:
    """All values without headers."""
    return F.array_join(F.flatten(F.array(*(distinct_first(F.col(c)) for c in columns))), " ")


def method_text(names: str = "methodNames") -> Column:
    kinds = [("Methods", names), ("Identifiers", "identifiers"), ("Comments", "comments"), ("Messages", "literals")]
    return labelled_text([(label, distinct_first(F.col(c))) for label, c in kinds])


def estimate_tokens(text: Column, bytes_per_token: int = 3) -> Column:
    """UTF-8 bytes over three, rounded up."""
    return F.ceil(F.octet_length(text) / bytes_per_token).cast("long")


def compact_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def strip_fences(answer: Column) -> Column:
    """Without Markdown fences (json or jsonl) at line starts."""
    return F.trim(F.regexp_replace(answer, r"(?m)^\s*```(?:jsonl?|JSONL?)?\s*$", ""))


def parse_object(text: Column, schema: str) -> Column:
    """A JSON object, or null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def normalise_label(label: Column) -> Column:
    """One pair of quotes off, ``a/b`` as ``a / b``, white space collapsed."""
    bare = F.trim(label)
    wrapped = any_of([(F.length(bare) >= 2) & bare.startswith(q[0]) & bare.endswith(q[1]) for q in QUOTES])
    bare = F.when(wrapped, F.trim(F.substr(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))))).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(bare, r"(?<=[\p{L}\p{N}_])/(?=[\p{L}\p{N}_])", " / "), r"\s+", " ")


def valid_label(label: Column) -> Column:
    """Two to six words, joined by spaces or a connector between spaces."""
    words = F.size(F.regexp_extract_all(label, F.lit(f"({LABEL_WORD})"), F.lit(1)))
    return label.rlike(f"^{LABEL_WORD}(?:{LABEL_JOIN}{LABEL_WORD})+$") & words.between(2, 6)


def valid_topic_label(label: Column) -> Column:
    return label.rlike("^[A-Za-z]+(?: [A-Za-z]+){1,3}$")


def bounded_list(values: Column, budget: int, longest: int = 160) -> Column:
    """Distinct values in order until ``budget`` characters are used; a value is cut at ``longest`` with an ellipsis."""
    cut = F.transform(F.array_distinct(F.transform(values, normalise_prose)), lambda v: F.when(F.length(v) > longest, F.concat(F.substr(v, F.lit(1), F.lit(longest - 1)), F.lit("…"))).otherwise(v))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("full"))

    def step(acc: Column, v: Column) -> Column:
        fits = ~acc["full"] & (acc["used"] + F.length(v) <= budget)
        return F.struct(F.when(fits, acc["used"] + F.length(v)).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["out"], F.array(v))).otherwise(acc["out"]).alias("out"), (~fits).alias("full"))

    return F.aggregate(cut, start, step, lambda acc: acc["out"])
