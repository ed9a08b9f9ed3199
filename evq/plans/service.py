"""Answering a question: route, evidence, one synthesis, validation. Language model and embedder are adapters."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import subprocess
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np

from evq.plans import grounding, resolution, routing
from evq.plans.evaluate import redact
from evq.plans.guard import Guard, Verdict, literal_issues, single_object_issues, source_issues
from evq.plans.resolution import Resolver
from evq.plans.retrieval import Evidence


class LanguageModel(Protocol):
    def run(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Scripted:
    """A language model that says what it is told to, for tests."""

    def __init__(self, *replies: str):
        self.replies, self.prompts = list(replies), []

    def run(self, prompt: str) -> str:
        self.prompts.append(prompt)
        if not self.replies:
            raise RuntimeError("no reply left")
        return self.replies.pop(0)


class HashEmbedder:
    """Unit vectors from word hashes: deterministic and offline."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in re.findall(r"[^\W_]+", t.casefold()):
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % self.size] += 1 if h[4] & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


@dataclass
class Response:
    question: str
    status: str  # ok, clarification, unsupported or error
    route: str = ""
    answer: str = ""
    evidence: dict = field(default_factory=dict)
    reasons: list[str] = field(default_factory=list)
    timing: dict[str, float] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)


def parse_reply(text: str) -> dict:
    """One JSON object, which may stand in one fence: a statement, or why there is none."""
    body = text.strip()
    if body.startswith("```") and body.endswith("```") and len(body) > 6:
        body = body[3:-3].removeprefix("json")
    got = json.loads(body)
    if isinstance(got, dict) and isinstance(got.get("unsupported"), str) and "sql" not in got:
        raise Unsupported(got["unsupported"])
    if not isinstance(got, dict) or not isinstance(got.get("sql"), str):
        raise ValueError("not an object with sql")
    return got


class Unsupported(Exception):
    """The writer's word that the question can't be asked of these views."""


class CommandModel:
    """A language model behind a command that reads a prompt and writes its answer: one call, killed at the deadline."""

    def __init__(self, command: Sequence[str], timeout: float = 60.0):
        self.command, self.timeout = list(command), timeout

    def run(self, prompt: str) -> str:
        if not shutil.which(self.command[0]):
            raise ModelError("not_installed", self.command[0])
        try:
            done = subprocess.run(self.command, input=prompt, capture_output=True, text=True, timeout=self.timeout)
        except subprocess.TimeoutExpired:
            raise ModelError("timeout", f"{self.timeout:g} s") from None
        if done.returncode:
            raise ModelError("failed", str(redact(done.stderr.strip()[-300:])))
        if not done.stdout.strip():
            raise ModelError("empty", "")
        return done.stdout


class ModelError(RuntimeError):
    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


class CachedEmbedder:
    """Remembers what an embedder said of a text, and tells its failures as one kind of error."""

    def __init__(self, embedder: Embedder, size: int):
        self.embedder, self.size, self.known = embedder, size, {}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        try:
            got = self.embedder.embed(new) if new else []
        except Exception as e:
            raise ModelError("embedder", type(e).__name__) from e
        if len(got) != len(new) or any(len(v) != self.size or not np.isfinite(v).all() for v in got):
            raise ModelError("embedder", "malformed")
        self.known |= dict(zip(new, got))
        return [self.known[t] for t in texts]


def schema_context(guard: Guard, families: dict[str, str], source: str) -> str:
    """What the writer of a statement may see: views of the source with their columns and types."""
    views = {name: df for name, df in guard.views.items() if families.get(name) == source}
    return "\n".join(f"{name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)})" for name, df in sorted(views.items()))


def available(guard: Guard, families: dict[str, str], source: str, metric: str) -> bool:
    """Whether a column of the source's views is called so, in whole or as one of its words."""
    return any(metric.lower() in f.name.lower().split("_") or metric.lower() == f.name.lower() for name, df in guard.views.items() if families.get(name) == source for f in df.schema)


METRICS = ("irr", "moic", "aum")
NAMES = {routing.INVESTMENT: "investments", routing.PERFORMANCE: "performance"}
#: Fixed answers where there is nothing to tell.
NOTHING = {"no_data": "There is no data for this in the source.", "no_lexical_match": "No meeting of those in scope holds these words.", "no_meetings_for_filter": "No meeting passes these filters."}


@dataclass
class Side:
    """Evidence of one kind of source: state, and what goes into the answer."""

    state: str = "evidence"
    reasons: list[str] = field(default_factory=list)
    rows: list = field(default_factory=list)
    hits: list[dict] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    note: str = ""


class Service:
    """families: the source of each view of the guard. retrieve(question, mentions) gives the Evidence of a search.
    resolver: finds names in questions. meetings: a guard over one view of meetings, for aggregates."""

    def __init__(self, guard: Guard, families: dict[str, str], model: LanguageModel, retrieve: Callable[[str, list], Evidence], resolver: Resolver | None = None, meetings: Guard | None = None):
        self.guard, self.families, self.model, self.retrieve, self.resolver, self.meetings = guard, families, model, retrieve, resolver, meetings

    def answer(self, question: str) -> Response:
        out = Response(question, "ok")
        began = time.perf_counter()
        try:
            self._answer(question.strip(), out)
        except Exception as e:
            out.status, out.reasons = "error", [f"internal_error:{e.code if isinstance(e, ModelError) else type(e).__name__}"]
        out.timing["total_ms"] = (time.perf_counter() - began) * 1000
        return out

    def timed(self, out: Response, name: str, f: Callable, *args):
        began = time.perf_counter()
        try:
            return f(*args)
        finally:
            out.timing[f"{name}_ms"] = (time.perf_counter() - began) * 1000

    def _answer(self, q: str, out: Response) -> None:
        if not q:
            out.status, out.reasons = "clarification", ["empty_question"]
            return
        mentions = self.timed(out, "entities", self.resolver.in_question, q) if self.resolver else []
        resolved = [m.resolution for m in mentions if m.resolution.canonical]
        r = routing.route(q, [x.etype for x in resolved], any(x.etype == "client" and x.sources == ("meetings",) for x in resolved))
        out.route = r.route
        out.evidence["entities"] = [{"text": m.text, "type": m.resolution.etype, "status": m.resolution.status, "canonical": m.resolution.canonical, "candidates": list(m.resolution.candidates)} for m in mentions]
        unclear = [m for m in mentions if m.resolution.status != "resolved" and not m.resolution.text_only]
        if unclear:  # before any evidence is read
            out.status, out.reasons = "clarification", [f"{m.resolution.status}:{m.text}" for m in unclear]
            return
        if r.route == routing.AMBIGUOUS:
            out.status, out.reasons = "unsupported" if r.rule == "rm_meeting_link" else "clarification", [r.rule]
            return
        sides: dict[str, Side] = {}
        if r.route in (routing.INVESTMENT, routing.PERFORMANCE, routing.HYBRID):
            family = r.route if r.route != routing.HYBRID else routing.halves(q)[0]
            sides[NAMES[family]] = self.timed(out, "structured", self.structured, q, NAMES[family], family, mentions, out)
        if r.route in (routing.MEETING, routing.HYBRID):
            sides["meetings"] = self.timed(out, "meetings", self.meeting, q if r.route == routing.MEETING else routing.halves(q)[1], mentions, out)
        for state, status in (("clarification", "clarification"), ("unsupported", "unsupported"), ("error", "error")):
            bad = [x for s in sides.values() if s.state == state for x in s.reasons]
            if bad:
                out.status = status
                out.reasons = bad + (["hybrid_partial_failure"] if len(sides) > 1 and any(s.state == "evidence" for s in sides.values()) else [])
                return
        if all(s.state == "no_data" for s in sides.values()):
            out.answer = " ".join(s.note for s in sides.values())
            out.reasons = [x for s in sides.values() for x in s.reasons]
            return
        self.timed(out, "synthesis", self.told, q, sides, out)

    def written(self, guard: Guard, families: dict[str, str], source: str, q: str, constraints: Sequence[tuple[str, str]]) -> tuple[str, Verdict]:
        kept = "".join(f" Keep {c} = {v!r}." for c, v in constraints)
        prompt = f"Write one SELECT as JSON with the key sql, or unsupported with a reason. Views of {source}:\n{schema_context(guard, families, source)}\nCount rows and distinct clients apart; sum one currency at a time.{kept}\nQuestion: {q}"
        reply = parse_reply(self.model.run(prompt))
        return reply["sql"], guard.validate(reply["sql"])

    def structured(self, q: str, source: str, family: str, mentions: list, out: Response) -> Side:
        gate = resolution.gate(mentions, source)
        if gate.outcome != "open":
            state = resolution.evidence_state(gate.outcome)
            return Side(state, [f"{gate.code}:{','.join(gate.texts)}"], note=NOTHING["no_data"])
        absent = [m for m in METRICS if family == routing.PERFORMANCE and routing.phrases(q, (m,)) and not available(self.guard, self.families, family, m)]
        if absent:
            return Side("unsupported", [f"unavailable_metric:{m}" for m in absent])
        try:
            sql, verdict = self.written(self.guard, self.families, family, q, gate.constraints)
        except Unsupported as e:
            return Side("unsupported", [f"writer:{e}"])
        issues = verdict.issues or [*source_issues(verdict.tables, self.families, family), *literal_issues(verdict, [v for _, v in gate.constraints])]
        if issues:
            out.evidence["structured"] = {"sql": sql, "outcome": "rejected", "issues": issues, "rows": []}
            return Side("error", issues)
        got = self.guard.run(verdict)
        out.evidence["structured"] = got | {"sql": sql, "rules": list(resolution.applied_rules(source, verdict.tables)), "notes": list(gate.notes)}
        if got["outcome"] != "ok":
            return Side("error", got["issues"])
        if not got["rows"]:
            return Side("no_data", ["no_rows"], note=NOTHING["no_data"])
        lines = [", ".join(got["columns"])] + [", ".join(map(str, x)) for x in got["rows"]] + (["(cut)"] if got["truncated"] else [])
        return Side("evidence", [], got["rows"], lines=lines)

    def meeting(self, q: str, mentions: list, out: Response) -> Side:
        names = [m.text for m in mentions]
        wanted = routing.intent(q, names)
        if wanted == "unsupported":
            return Side("unsupported", ["date_relation"])
        if wanted == "aggregate" and self.meetings:
            gate = resolution.gate(mentions, "meetings")
            if gate.outcome != "open":
                return Side(resolution.evidence_state(gate.outcome), [f"{gate.code}:{','.join(gate.texts)}"], note=NOTHING["no_data"])
            families = dict.fromkeys(self.meetings.views, "meeting")
            try:
                sql, verdict = self.written(self.meetings, families, "meeting", q, gate.constraints)
            except Unsupported as e:
                return Side("unsupported", [f"writer:{e}"])
            issues = verdict.issues or [*single_object_issues(verdict), *literal_issues(verdict, [v for _, v in gate.constraints])]
            got = self.meetings.run(verdict) if not issues else {"outcome": "rejected", "issues": issues, "rows": [], "columns": []}
            out.evidence["aggregate"] = got | {"sql": sql}
            if got["outcome"] != "ok":
                return Side("error", got["issues"])
            return Side("evidence", [], got["rows"], lines=[", ".join(got["columns"])] + [", ".join(map(str, x)) for x in got["rows"]])
        found = self.retrieve(q, mentions)
        out.evidence["meetings"] = found.hits
        out.evidence["search"] = {"outcome": found.outcome, "filtered": found.filtered, "matched": found.matched, "unmatched": grounding.unmatched(found.filtered, found.matched, found.method == "day"), "status": found.status, "notes": list(found.notes)}
        state = resolution.evidence_state(found.outcome)
        if state != "evidence":
            return Side(state, [found.outcome], note=NOTHING.get(found.outcome, NOTHING["no_data"]))
        head = f"{found.matched} of {found.filtered} meetings in scope hold the words; {len(found.hits)} are shown."
        key = next((k for k in ("id", "doc_id") if found.hits and k in found.hits[0]), "id")
        hits = [{"id": h[key], "date": str(h["day"]), "text": h["snippet"], "actions": h.get("actions", "")} for h in found.hits]
        return Side("evidence", [], hits=hits, lines=[head, *(f"meeting {h['id']}, {h['date']}: {h['text']}" for h in hits)])

    def told(self, q: str, sides: dict[str, Side], out: Response) -> None:
        live = {name: s for name, s in sides.items() if s.state == "evidence"}
        parts = grounding.trimmed([[f"[{name}] {s.lines[0]}", *s.lines[1:]] for name, s in live.items()])
        out.answer = self.model.run("Answer from this evidence only and cite it as [investments], [performance], [meetings] or [meeting: number, date].\n" + "\n".join("\n".join(p) for p in parts) + f"\nQuestion: {q}").strip()
        hits = [h for s in live.values() for h in s.hits]
        search = out.evidence.get("search", {})
        notes = [float(v) for v in (search.get("filtered"), search.get("matched"), search.get("unmatched"), len(hits)) if v is not None]
        structured = [r for name, s in live.items() if name != "meetings" for r in s.rows]
        counted = live["meetings"].rows if "meetings" in live else []
        checked = grounding.validate_sides(out.answer, structured, counted, list(live), {h["id"]: h["date"] for h in hits}, [h["text"] for h in hits], q, notes)
        out.reasons = checked.reasons + checked.warnings
        if not checked.valid:
            out.status, out.answer = "error", ""
