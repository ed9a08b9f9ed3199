"""Names in questions: a dictionary of what each source calls its entities, exact resolution, mentions and gates.

The dictionary is a DataFrame and may be large; a question asks it for the few keys it could mean. Nothing is guessed:
a name resolves if its exact or its normal form stands for one entity, and else it's ambiguous or not found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.plans.routing import folded, words_of

RESOLVED, AMBIGUOUS, NOT_FOUND = "resolved", "ambiguous", "not_found"
#: The types that resolve, the contexts that are text of meetings only, and the most candidates shown.
TYPES = ("client", "group", "deal_id", "deal_name", "rm")
CONTEXTS = ("company", "attendee")
CANDIDATES = 10
GROUP_WORDS = ("group", "client group", "group id", "client group id")
#: Lines of business are no names, though they are written like ones.
BUSINESS_LINES = ("private equity", "hedge fund", "hedge funds", "real estate")


@dataclass(frozen=True)
class Resolution:
    text: str
    etype: str
    status: str
    canonical: str | None = None
    rule: str = "no_match"
    candidates: tuple[tuple[str, str], ...] = ()  # type or context, value: sorted, CANDIDATES at most
    more: int = 0  # candidates not shown
    sources: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()
    contexts: tuple[tuple[str, int], ...] = ()  # candidates by type or context
    details: tuple[tuple[str, str], ...] = ()
    text_only: bool = False  # known as text of meetings, never as an entity

    def detail(self, name: str) -> str | None:
        return dict(self.details).get(name)


@dataclass(frozen=True)
class Mention:
    text: str
    start: int
    resolution: Resolution


def key_of(text: str) -> str:
    return " ".join(folded(text))


def dictionary(parts: Iterable[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """etype, form, source, value, said, n, key of parts (type or context, form, source, a table of value and said):
    one row for each way to say an entity in a source, n being the rows that say it so."""
    out = None
    for etype, form, source, df in parts:
        value, said = df.columns[0], df.columns[-1]
        one = df.select(F.lit(etype).alias("etype"), F.lit(form).alias("form"), F.lit(source).alias("source"), F.col(value).cast("string").alias("value"), F.col(said).cast("string").alias("said"))
        out = one if out is None else out.unionByName(one)
    key = F.pandas_udf(lambda s: s.map(key_of), "string")
    return out.where("value is not null and said is not null").groupBy("etype", "form", "source", "value", "said").agg(F.count("*").alias("n")).withColumn("key", key("said"))


def client_shape(text: str) -> bool:
    t = text.strip().lower()
    return len(t) == 6 and t[0] in "abcd" and t[1:].isascii() and t[1:].isdigit()


def deal_shape(text: str) -> bool:
    t = text.strip().lower()
    return len(t) == 8 and t.startswith("dl") and t[2:].isascii() and t[2:].isdigit()


def bare_number(text: str) -> bool:
    t = text.strip()
    return len(t) == 5 and t.isascii() and t.isdigit()


def group_number(text: str) -> str | None:
    said = folded(text.replace("_", " ").replace("#", " "))
    if not said or not (said[-1].isascii() and said[-1].isdigit()):
        return None
    return str(int(said[-1])) if len(said) == 1 or " ".join(said[:-1]) in GROUP_WORDS else None


class Resolver:
    """words: a dictionary(). members: source, group_id, client rows, from which groups are told."""

    def __init__(self, words: DataFrame, members: DataFrame | None = None):
        self.words, self.members = words, members
        self.longest = words.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1

    def rows(self, keys: Iterable[str], etypes: Sequence[str] = (*TYPES, *CONTEXTS)) -> list:
        return self.words.where(F.col("key").isin(list(keys)) & F.col("etype").isin(list(etypes))).collect()

    def lookup(self, text: str, etypes: Sequence[str]) -> tuple[str, list]:
        """Rows that say exactly the text; else those of its normal form."""
        rows = self.rows([key_of(text)], etypes)
        exact = [r for r in rows if r["said"] == text.strip()]
        return ("exact", exact) if exact else ("normalized", rows)

    def resolve(self, text: str, etype: str | None = None) -> Resolution:
        if etype == "group":
            return self._group(text)
        if etype == "rm" and "@" in text:
            return Resolution(text, "rm", NOT_FOUND, rule="non_authoritative")
        if etype:
            rule, rows = self.lookup(text, (etype,))
            if rows:
                return self._pick(text, etype, rule, rows)
            if etype == "client" and bare_number(text):
                return self._suffix(text)
            return self._partial(text, etype, (etype,)) if etype in ("deal_name", "rm") else Resolution(text, etype, NOT_FOUND)
        return self._untyped(text)

    def _untyped(self, text: str) -> Resolution:
        """Number of a client without its letter, group, any type, text of meetings, part of a name: in this order."""
        if bare_number(text):
            return self._suffix(text)
        if group_number(text) is not None:
            return self._group(text)
        rule, rows = self.lookup(text, TYPES)
        if rows:
            kinds, values = {r["etype"] for r in rows}, {(r["etype"], r["value"]) for r in rows}
            return self._pick(text, kinds.pop(), rule, rows) if len(values) == 1 else self._ambiguous(text, kinds.pop() if len(kinds) == 1 else "", rule, rows)
        _, rows = self.lookup(text, CONTEXTS)
        if rows:
            told = tuple(sorted((f"{r['etype']}:{r['value']}", str(r["n"])) for r in rows))
            return Resolution(text, "", NOT_FOUND, rule="meeting_text", details=told, text_only=True)
        found = self._partial(text, "", (*TYPES, *CONTEXTS))
        if found.status == AMBIGUOUS:
            return found
        return Resolution(text, "client" if client_shape(text) else "deal_id" if deal_shape(text) else "", NOT_FOUND)

    def _pick(self, text: str, etype: str, rule: str, rows: list) -> Resolution:
        values = {r["value"] for r in rows}
        if len(values) > 1:
            return self._ambiguous(text, etype, rule, rows)
        value = values.pop()
        known = self.words.where((F.col("etype") == etype) & (F.col("value") == value)).select("source", "form", "n").collect()
        sources, details = tuple(sorted({r["source"] for r in known})), {"records": str(sum(r["n"] for r in rows))}
        if etype == "client" and len(sources) == 1:
            details["only_in"] = sources[0]
        if etype == "deal_id":
            details["deal_names"] = str(self.words.where((F.col("etype") == "deal_name") & (F.col("form") == "of_deal") & (F.col("value") == value)).count())
        others = self.rows([key_of(value)], CONTEXTS)
        if others:
            details["also"] = ",".join(sorted({r["etype"] for r in others}))
        return Resolution(text, etype, RESOLVED, value, rule, sources=sources, forms=tuple(sorted({r["form"] for r in rows})), details=tuple(sorted(details.items())))

    def _ambiguous(self, text: str, etype: str, rule: str, rows: list) -> Resolution:
        every = sorted({(r["etype"], r["value"]) for r in rows}, key=lambda c: (c[0] not in TYPES, c))
        counts = tuple(sorted(Counter(k for k, _ in every).items()))
        return Resolution(text, etype, AMBIGUOUS, None, rule, tuple(every[:CANDIDATES]), max(0, len(every) - CANDIDATES), tuple(sorted({r["source"] for r in rows})), contexts=counts, text_only=all(k in CONTEXTS for k, _ in every))

    def _suffix(self, text: str) -> Resolution:
        digits = text.strip()
        rows = self.words.where((F.col("etype") == "client") & (F.substring("value", 2, 10) == digits)).collect()
        return self._ambiguous(text, "client", "numeric_suffix", rows) if rows else Resolution(text, "client", NOT_FOUND, rule="numeric_suffix")

    def _partial(self, text: str, etype: str, etypes: Sequence[str]) -> Resolution:
        """Names that hold the text as whole words: told, never resolved."""
        key = key_of(text)
        if not any(len(w) >= 3 for w in key.split()):
            return Resolution(text, etype, NOT_FOUND)
        rows = self.words.where(F.col("etype").isin(list(etypes)) & F.concat(F.lit(" "), F.col("key"), F.lit(" ")).contains(f" {key} ")).collect()
        return self._ambiguous(text, etype, "partial", rows) if rows else Resolution(text, etype, NOT_FOUND)

    def _group(self, text: str) -> Resolution:
        number = group_number(text)
        if number is None or self.members is None:
            return Resolution(text, "group", NOT_FOUND)
        rows = self.members.where(F.col("group_id").cast("string") == number).groupBy("source").agg(F.sort_array(F.collect_set("client")).alias("c")).collect()
        if not rows:
            return Resolution(text, "group", NOT_FOUND)
        differs = len({tuple(r["c"]) for r in rows}) > 1
        sizes = tuple((f"members:{r['source']}", str(len(r["c"]))) for r in rows)
        return Resolution(text, "group", RESOLVED, number, "exact", sources=tuple(sorted(r["source"] for r in rows)), forms=("group_id",), details=tuple(sorted((*sizes, ("membership_differs", str(differs).lower())))))

    def in_question(self, question: str) -> list[Mention]:
        """The longest names first, none overlapping: names of the dictionary, "group N", ids of a known shape, bare
        numbers, e-mail addresses. Lines of business are skipped."""
        found = words_of(question)
        runs = {(i, n): " ".join(w.text for w in found[i : i + n]) for i in range(len(found)) for n in range(1, min(self.longest, len(found) - i) + 1)}
        known = {r["key"] for r in self.rows(set(runs.values()))}
        spans: list[tuple[int, int]] = [(i, n) for (i, n), key in runs.items() if key in known and key not in BUSINESS_LINES]
        for i, w in enumerate(found):
            said = question[w.start : w.end]
            if client_shape(said) or deal_shape(said) or bare_number(said):
                spans.append((i, 1))
            for phrase in GROUP_WORDS:
                n = len(phrase.split())
                if [x.text for x in found[i : i + n]] == phrase.split() and i + n < len(found) and found[i + n].text.isdigit():
                    spans.append((i, n + 1))
        taken: set[int] = set()
        out = []
        for i, n in sorted(set(spans), key=lambda s: (-(found[s[0] + s[1] - 1].end - found[s[0]].start), s[0])):
            if taken.isdisjoint(range(i, i + n)):
                taken |= set(range(i, i + n))
                text = question[found[i].start : found[i + n - 1].end]
                out.append(Mention(text, found[i].start, self.resolve(text)))
        at = 0
        for part in question.split():
            at = question.index(part, at)
            if "@" in part.strip("@.,;:?!"):
                out.append(Mention(part, at, self.resolve(part, "rm")))
        return sorted(out, key=lambda m: m.start)

    def capitalised(self, question: str) -> list[str]:
        """Runs of capitalised words behind the first, none of them known: what may have been meant as a name."""
        found, out, run = words_of(question), [], []
        for w in found[1:] + [None]:
            if w is not None and question[w.start].isupper():
                run.append(w)
            elif run:
                out.append(question[run[0].start : run[-1].end])
                run = []
        known = {r["key"] for r in self.rows([key_of(t) for t in out])}
        return [t for t in out if key_of(t) not in known and key_of(t) not in BUSINESS_LINES]


@dataclass(frozen=True)
class Gate:
    """What names allow before any evidence is read: open, or why not; and the constraints that the query must keep."""

    outcome: str = "open"
    code: str = ""
    texts: tuple[str, ...] = ()
    constraints: tuple[tuple[str, str], ...] = ()  # column, value
    notes: tuple[str, ...] = field(default=())


COLUMNS = {"client": "client_id", "group": "group_id", "deal_id": "deal_id", "deal_name": "deal_name", "rm": "account_rm"}


def gate(mentions: Sequence[Mention], source: str, search: bool = False) -> Gate:
    """source: investments, performance or meetings. search: of meetings by words, where deals and words known from
    meetings only are searched for as words."""
    for status, outcome, code in ((AMBIGUOUS, "clarification_needed", "ambiguous_entity"), (NOT_FOUND, "entity_not_found", "entity_not_found")):
        bad = tuple(m.text for m in mentions if m.resolution.status == status and not (source == "meetings" and m.resolution.text_only))
        if bad:
            return Gate(outcome, code, bad)
    kept, notes = [], []
    for m in mentions:
        r = m.resolution
        if r.status != RESOLVED:
            notes.append(f"words_only:{m.text}")
        elif r.etype in ("client", "group"):
            if source not in r.sources:
                return Gate("no_data", "no_data_for_entity", (r.canonical,))
            kept.append((COLUMNS[r.etype], r.canonical))
            if r.detail("membership_differs") == "true":
                notes.append(f"membership_differs:{r.canonical}")
        elif source == "meetings" and r.etype == "rm":
            return Gate("unsupported", "rm_meeting_link", (r.canonical,))
        elif source == "meetings":
            if not search:
                return Gate("unsupported", "deal_not_in_meetings", (r.canonical,))
            notes.append(f"words_only:{m.text}")
        elif source != "investments":
            return Gate("no_data", "not_in_source", (r.canonical,))
        else:
            kept.append((COLUMNS[r.etype], r.canonical))
            if r.etype == "rm":
                notes.append("record_level:rm")
    return Gate("open", "", (), tuple(kept), tuple(notes))


def evidence_state(outcome: str) -> str:
    """What an outcome means for the answer: evidence, no_data, clarification, unsupported or error."""
    states: Mapping[str, tuple[str, ...]] = {
        "evidence": ("ok", "open"),
        "no_data": ("no_data", "no_meeting_data", "no_lexical_match", "no_meetings_for_filter"),
        "clarification": ("clarification_needed", "entity_not_found", "no_terms"),
        "unsupported": ("unsupported", "unsupported_rm", "unavailable_metric"),
    }
    return next((state for state, outcomes in states.items() if outcome in outcomes), "error")


def applied_rules(source: str, tables: Iterable[str]) -> tuple[str, ...]:
    """The rules that hold for a guarded query, to be told with its evidence."""
    said = {"investments": ("manager_is_record_level", "status_is_record_level", "rows_are_not_clients"), "performance": ("multiples_as_numbers",), "meetings": ("one_table_no_join",)}[source]
    by_table = {"performance_latest": "latest_of_each_client", "performance_client": "no_group_rows", "performance_group": "group_rows_only"}
    return (*said, *(by_table[t] for t in sorted(tables) if t in by_table), "read_only_one_source")
