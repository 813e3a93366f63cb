"""License scan: ordered signature rules over whole texts.

1. A text is brought to *normal text* once: A-Z in lower case, words
   (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with one space between, before and after.
2. Base phrases are counted by splitting the normal text at them.
3. A *keyword prefilter* finds the rules that a text can match: one expression in the form of a trie finds the
   stems (beginnings of words) that it holds, and of the rules with these stems those are tried whose keyword it holds.
   Each is tried once: its matches are marked in the normal text, and the marked words are counted out.
4. Overlaps are resolved by *priority and interval containment*: a detection
   inside another of the same or higher priority is dropped; of two at one place, the
   earlier rule stands.  One sweep over the detections in order of their start, chunk by chunk, so that
   the work grows in proportion to them.

Everything is DataFrame functions in one pass without a shuffle.

Defined results: null and empty texts have no words, no places, empty labels and
score 0; repeated rows are repeated; other columns are kept, those named like a result are replaced;
an empty table gives no rows.  Texts are scanned whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused
from .license_rules import LicenseRule, build_rules, trie, with_stems

#: phrases that are always counted, and their labels
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: in order of start, length, priority and rule
_SPAN = "array<struct<start:int,nstop:int,npriority:int,rule:int,stop:int,priority:int,label:string,confidence:double>>"
_RULE = "array<struct<id:int,label:string,keyword:string,regex:string,priority:int,confidence:double>>"
#: detections that are resolved at once
CHUNK = 256
#: around a match in marked text; no word holds them
_OPEN, _CLOSE = "\x01", "\x02"


def normal_text(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(text, upper, upper.lower())
    return F.coalesce(F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), _NOT_WORD, " "), F.lit(" "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _whole(regex: str) -> str:
    return rf"(?<= )(?:{regex})(?= )"


def base_places(normal: Column, n_words: Column, phrase: str) -> Column:
    """struct(n, first, last) of the places of a phrase."""
    parts = F.split(normal, _whole(phrase), -1)
    n = F.size(parts) - 1
    first = spaces(parts[0]) - 1
    last = n_words - (spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())
    held = F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))
    return F.when(F.contains(normal, F.lit(f" {phrase} ")), held)


def _spans_of(normal: Column, rule: Column) -> Column:
    """Word intervals of all matches of a rule."""

    def spans(words: Column) -> Column:
        places = lambda hit: F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
        stops = places(lambda w: w.endswith(_CLOSE))

        def one(start: Column, k: Column, stops: Column) -> Column:
            stop = F.get(stops, k)
            return F.struct(
                (start - 1).alias("start"), (-stop).alias("nstop"), (-rule.priority).alias("npriority"), rule.id.alias("rule"),
                stop.alias("stop"), rule.priority.alias("priority"), rule.label.alias("label"), rule.confidence.alias("confidence"),
            )

        return _bind(stops, lambda ends: F.transform(places(lambda w: w.startswith(_OPEN)), lambda start, k: one(start, k, ends)))

    marked = F.regexp_replace(normal, rule.regex, F.lit(f"{_OPEN}$0{_CLOSE}"))
    # normal text begins with a blank, so that its first word is number 1
    return _bind(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), spans(F.split(m, " "))).otherwise(F.array()).cast(_SPAN))


def _bind(value: Column, then) -> Column:  # noqa: ANN001 - a name for a value inside a lambda
    return F.transform(F.array(value), then)[0]


def resolve(spans: Column, levels: int = 3) -> Column:
    """Drop detections inside others of the same or higher priority."""
    names = [f"m{i}" for i in range(1, levels + 1)]  # furthest stop so far at each priority
    ends = ",".join(f"{n}:int" for n in names)

    def step(acc: Column, x: Column) -> Column:
        covered = F.lit(False)
        for i, n in enumerate(names, 1):
            covered = covered | ((x.priority <= i) & (acc[n] >= x.stop))
        new = [F.when(x.priority == i, F.greatest(acc[n], x.stop)).otherwise(acc[n]).alias(n) for i, n in enumerate(names, 1)]
        return F.struct(*new, F.concat(acc.keep, F.array(~covered)).alias("keep")).cast(f"struct<{ends},keep:array<boolean>>")

    def chunk(acc: Column, part: Column) -> Column:
        zero = F.struct(*[acc[n].alias(n) for n in names], F.array().cast("array<boolean>").alias("keep"))
        inner = F.aggregate(part, zero.cast(f"struct<{ends},keep:array<boolean>>"), step)
        return _bind(inner, lambda r: F.struct(*[r[n].alias(n) for n in names], F.concat(acc.keep, F.array(r.keep)).alias("keep")).cast(f"struct<{ends},keep:array<array<boolean>>>"))

    def swept(ordered: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(ordered) - 1, F.lit(CHUNK)), lambda at: F.slice(ordered, at + 1, F.lit(CHUNK)))
        zero = F.struct(*[F.lit(-1).alias(n) for n in names], F.array().cast("array<array<boolean>>").alias("keep"))
        keep = F.aggregate(parts, zero.cast(f"struct<{ends},keep:array<array<boolean>>>"), chunk, lambda acc: F.flatten(acc.keep))
        return _bind(keep, lambda k: F.filter(ordered, lambda x, i: F.get(k, i)))

    return _bind(F.array_sort(spans), lambda ordered: F.when(F.size(ordered) > 1, swept(ordered)).otherwise(ordered))


def scan(df: DataFrame, text_col: str = "text", rules: tuple[LicenseRule, ...] | None = None, base=BASE) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and ``detections``."""
    rules = rules or build_rules()
    rules = rules if all(r.stem for r in rules) else with_stems(list(rules))
    told: dict[str, list[dict]] = {}
    for i, r in enumerate(rules):
        told.setdefault(r.stem, []).append({"id": i, "label": r.label, "keyword": r.keyword, "regex": _whole(r.regex), "priority": r.priority, "confidence": r.confidence})
    table = F.from_json(F.lit(json.dumps(told)), f"map<string,{_RULE}>")  # a constant, made once
    stems = F.lit(f" ({trie(list(told))})")
    names = {k: unused(df, k) for k in ("normal", "words", "spans", "base", "kept")}
    n, w = F.col(names["normal"]), F.col(names["words"])
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    own = [F.col(f"`{c}`") for c in df.columns if c not in added]
    step = df.select(*own, normal_text(F.col(f"`{text_col}`")).alias(names["normal"]))
    step = step.withColumn(names["words"], (spaces(n) - 1).cast("long"))
    held = F.array_distinct(F.regexp_extract_all(n, stems, F.lit(1)))
    tried = F.filter(F.flatten(F.transform(held, lambda s: F.element_at(table, s))), lambda r: F.contains(n, r.keyword))
    spans = F.flatten(F.transform(tried, lambda r: _spans_of(n, r)))
    base_ = F.array_compact(F.array(*[_labelled(n, w, p, label) for p, label in base]))
    step = step.select(*own, w, spans.alias(names["spans"]), base_.alias(names["base"]))
    step = step.withColumn(names["kept"], resolve(F.col(names["spans"])))
    found, kept = F.col(names["base"]), F.col(names["kept"])
    labels = F.array_sort(F.array_distinct(F.transform(found, lambda x: x.label)))
    all_labels = F.array_sort(F.array_distinct(F.concat(labels, F.transform(kept, lambda x: x.label))))
    doubt = F.aggregate(kept, F.lit(1.0), lambda a, x: a * (1 - x.confidence))
    fields = ("start", "stop", "priority", "rule", "label", "confidence")
    return step.select(
        *own,
        w.alias("n_words"),
        F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.places.n).alias("n_base"),
        F.array_min(F.transform(found, lambda x: x.places.first)).alias("first_word"),
        F.array_max(F.transform(found, lambda x: x.places.last)).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size(found) > 0, 1.0).otherwise(1 - doubt).alias("score"),
        F.transform(kept, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("detections"),
    )


def _labelled(normal: Column, n_words: Column, phrase: str, label: str) -> Column:
    places = base_places(normal, n_words, phrase)
    return F.when(places.isNotNull(), F.struct(F.lit(label).alias("label"), places.alias("places")))
