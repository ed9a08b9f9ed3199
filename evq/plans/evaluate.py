"""Scoring answers by their evidence, summaries and traces."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from statistics import mean, median

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SECRET_KEYS = frozenset("token authorization password secret api_key".split())


def redact(value):
    if isinstance(value, dict):
        return {k: "[redacted]" if str(k).lower() in SECRET_KEYS else redact(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(map(redact, value))
    return UUID.sub("[uuid]", EMAIL.sub("[email]", value)) if isinstance(value, str) else value


class Trace:
    """Named steps one after another; start and end are sums of the durations before."""

    def __init__(self):
        self.events: list[dict] = []

    def record(self, name: str, status: str = "ok", duration_ms: float = 0.0, **metadata) -> None:
        start = self.events[-1]["end_ms"] if self.events else 0.0
        self.events.append({"name": name, "status": status, "start_ms": start, "end_ms": start + duration_ms, "metadata": redact(metadata)})


def leaves(value):
    if isinstance(value, dict):
        for v in value.values():
            yield from leaves(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from leaves(v)
    else:
        yield value


def same(expected, actual, tolerance: float = 0.0) -> bool:
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (expected, actual))
    return abs(expected - actual) <= tolerance if numbers else expected == actual


def score(question: dict, response: dict) -> dict:
    """question: status, values (with tolerance), ids, wrong values; correct if all that is asked for holds."""
    found = list(leaves(response.get("evidence", {})))
    checks = {"status": response.get("status") == question.get("status", "ok")}
    for v in question.get("values", ()):
        checks[f"value:{v}"] = any(same(v, x, question.get("tolerance", 0.0)) for x in found)
    if "ids" in question:
        checks["ids"] = {h["id"] for h in response["evidence"].get("meetings", [])} == set(question["ids"])
    for v in question.get("wrong", ()):
        checks[f"wrong:{v}"] = not re.search(rf"(?<![\w.]){re.escape(str(v))}(?![\w.])", response.get("answer", ""))
    return {"id": question.get("id"), "checks": checks, "correct": all(checks.values())}


def summarize(results: Sequence[dict]) -> dict:
    """Counts by category and status, and latencies in milliseconds, rounded to one decimal."""
    out: dict = {"n": len(results), "correct": sum(bool(r.get("correct")) for r in results), "by_status": {}, "by_category": {}}
    for r in results:
        out["by_status"][r.get("status")] = out["by_status"].get(r.get("status"), 0) + 1
        c = out["by_category"].setdefault(r.get("category"), {"n": 0, "correct": 0})
        c["n"] += 1
        c["correct"] += bool(r.get("correct"))
    if times := [r["ms"] for r in results if "ms" in r]:
        out |= {"mean_ms": round(mean(times), 1), "median_ms": round(median(times), 1), "max_ms": max(times)}
    return out


def markdown(summary: dict) -> str:
    rows = [f"| {k} | {v['n']} | {v['correct']} |" for k, v in summary["by_category"].items()]
    return "\n".join(["| category | n | correct |", "| --- | --- | --- |", *rows])


def failures(results: Sequence[dict]) -> list[dict]:
    """Results whose answer was withheld for what it said."""
    return [r for r in results if r.get("status") == "error" and any(str(x).startswith(("ungrounded", "missing_citation", "bad_citation", "denies", "summed")) for x in r.get("reasons", ()))]


def lookup(results: Sequence[dict], key: str) -> dict | None:
    return next((r for r in results if str(r.get("id")) == str(key)), None)


def question_set(rows: Sequence[dict], n: int | None = None) -> list[dict]:
    """A set of questions for an evaluation: each with an id of its own and a text, all visible, n of them if given."""
    ids = [r.get("id") for r in rows]
    if n is not None and len(rows) != n:
        raise ValueError(f"{len(rows)} questions, not {n}")
    if len(set(ids)) != len(ids) or not all(r.get("id") is not None and str(r.get("question", "")).strip() for r in rows):
        raise ValueError("each question needs an id of its own and a text")
    if any(r.get("split", "visible") != "visible" for r in rows):
        raise ValueError("only visible questions may be run")
    return [plain(r) for r in rows]


def plain(value):
    """Values as JSON has them: dates, decimals and the like as text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def run(questions: Sequence[dict], answer: Callable[[str], dict]) -> list[dict]:
    """Asks and scores every question; one that fails is a result too."""
    out = []
    for q in questions:
        began = time.perf_counter()
        try:
            got = answer(q["question"])
        except Exception as e:
            got = {"status": "error", "reasons": [type(e).__name__], "evidence": {}, "answer": ""}
        told = score(q, got)
        out.append(plain({"id": q["id"], "category": q.get("category"), "status": got["status"], "reasons": got.get("reasons", []), "correct": told["correct"], "checks": told["checks"], "ms": round((time.perf_counter() - began) * 1000, 1)}))
    return out
