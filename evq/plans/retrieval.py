"""Meetings found for a question: words and filters derived from it, gates, BM25 over the stored index, outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evq.operators import vectors
from evq.operators.lexical import snippet
from evq.operators.search_index import Index, folded_tokens
from evq.plans import resolution as R
from evq.plans import routing

MOST, DEFAULT = 50, 20
#: Outcomes with hits or a finding; the others tell why there is none.
VALID = ("ok", "no_lexical_match", "no_meetings_for_filter")
#: Quoted text of 2 to 80 characters is a phrase. The field of actions weighs more where a question asks for them.
QUOTED, ACTIONS_WEIGHT = (2, 80), 5.0
QUOTES = {'"': '"', "“": "”"}


@dataclass(frozen=True)
class Asked:
    terms: tuple[str, ...]
    phrases: tuple[str, ...]
    day: str | None
    actions: bool


def quoted(text: str) -> tuple[list[str], str]:
    """The quoted phrases of a text, and the text without them."""
    found, rest, at = [], "", 0
    while at < len(text):
        closer = QUOTES.get(text[at])
        end = text.find(closer, at + 1) if closer else -1
        if end > 0 and QUOTED[0] <= end - at - 1 <= QUOTED[1]:
            found.append(text[at + 1 : end])
            rest, at = rest + " ", end + 1
        else:
            rest, at = rest + text[at], at + 1
    return found, rest


def asked(question: str, remove: Sequence[str] = (), query_text: str | None = None) -> Asked:
    """Terms, phrases, the day and whether actions are asked for. A query text of the caller's is taken as it is: no
    words are left out, and an empty one lists."""
    for r in remove:
        question = question.replace(r, " ")
    day = routing.first_date(question)
    actions = bool(routing.phrases(question, ("action item", "action items")))
    said, rest = quoted(question if query_text is None else query_text)
    if query_text is None:
        if day:
            rest = rest.replace(day, " ")
        words = routing.terms(rest)[0]
    else:
        words = list(dict.fromkeys(folded_tokens(rest)))
    phrases = [" ".join(folded_tokens(p)) for p in said]
    return Asked(tuple(words), tuple(p for p in dict.fromkeys(phrases) if p), day, actions)


@dataclass
class Evidence:
    outcome: str
    hits: list[dict]
    filtered: int = 0
    matched: int = 0
    fewer_than_k: bool = True
    method: str | None = None
    asked: Asked | None = None
    notes: tuple[str, ...] = ()
    status: str = "lexical"

    @property
    def valid(self) -> bool:
        return self.outcome in VALID


class Search:
    """docs: one row a meeting, with columns client_id, group_id, day and the fields of the index; index may be None."""

    def __init__(self, index: Index | None, docs: DataFrame, doc_id: str, weights: dict[str, float], text: str, actions: str | None = None):
        self.index, self.docs, self.doc_id, self.weights, self.text, self.actions = index, docs, doc_id, weights, text, actions

    def scope(self, constraints: Sequence[tuple[str, str]], day: str | None, since: str | None = None, until: str | None = None) -> DataFrame:
        """The meetings that all filters leave; built once for the lexical and the semantic side."""
        out = self.docs
        clients = [v for c, v in constraints if c == "client_id"]
        if clients:
            out = out.where(F.col("client_id").cast("string").isin(clients))
        for column, value in constraints:
            if column == "group_id":
                out = out.where(F.col("group_id").cast("string") == value)
        for test in ([F.col("day") == day] if day else []) + ([F.col("day") >= since] if since else []) + ([F.col("day") <= until] if until else []):
            out = out.where(test)
        return out

    def retrieve(self, question: str, mentions: Sequence[R.Mention] = (), query_text: str | None = None, k: int = DEFAULT, since: str | None = None, until: str | None = None) -> Evidence:
        """The k best meetings: by BM25, then the newest, then the least id; without words the newest of the filters."""
        if not 1 <= k <= MOST:
            raise ValueError(f"k must be from 1 to {MOST}")
        if self.index is None:
            return Evidence("index_missing", [])
        gate = R.gate(mentions, "meetings", search=True)
        if gate.outcome != "open":
            outcome = {"no_data": "no_meeting_data", "unsupported": "unsupported_rm"}.get(gate.outcome, gate.outcome)
            return Evidence(outcome, [], notes=gate.texts)
        said = asked(question, [m.text for m in mentions if m.resolution.etype in ("client", "group") and m.resolution.canonical], query_text)
        wanted = [*said.terms, *said.phrases]
        if not wanted and not (gate.constraints or said.day or since or until):
            return Evidence("no_terms", [], asked=said, notes=gate.notes)
        scope = self.scope(gate.constraints, said.day, since, until)
        filtered = scope.count()
        if not filtered:
            return Evidence("no_meetings_for_filter", [], asked=said, notes=gate.notes)
        if not wanted:
            rows = scope.orderBy(F.desc("day"), self.doc_id).limit(k).select(self.doc_id, "day", F.substring(self.text, 1, 200).alias("snippet")).collect()
            return Evidence("ok", [r.asDict() | {"rank": i} for i, r in enumerate(rows, 1)], filtered, filtered, filtered < k, "day", said, gate.notes)
        weights = self.weights | ({self.actions: ACTIONS_WEIGHT} if self.actions and said.actions else {})
        scored = self.index.bm25(wanted, weights, scope).withColumn("score", F.round("bm25", 6)).drop("bm25")
        matched = scored.count()
        if not matched:
            return Evidence("no_lexical_match", [], filtered, 0, True, "bm25", said, gate.notes)
        top = scored.join(scope.select(self.doc_id, "day"), self.doc_id).orderBy(F.desc("score"), F.desc("day"), self.doc_id).limit(k)
        shown = top.join(self.docs.select(self.doc_id, self.text), self.doc_id).withColumn("snippet", snippet(F.col(self.text), [w for x in wanted for w in x.split()])).drop(self.text)
        rows = shown.orderBy(F.desc("score"), F.desc("day"), self.doc_id).collect()
        hits = [{self.doc_id: r[self.doc_id], "day": r["day"], "score": r["score"], "snippet": r["snippet"], "rank": i, "matched": [wanted[q] for q in r["matched"]], "fields": [self.index.fields[f] for f in r["in_fields"]]} for i, r in enumerate(rows, 1)]
        return Evidence("ok", hits, filtered, matched, matched < k, "bm25", said, gate.notes)


def merged_snippet(lexical: str, sentence: str, score: float) -> str:
    """The lexical snippet with the best sentence behind it, unless its first 40 characters are there already."""
    if sentence[:40] in lexical:
        return lexical
    return f'{lexical} | semantic match ({score:.3f}): "{sentence}"'.strip(" |")


class Hybrid:
    """Lexical search and sentence vectors, fused by rank. embed(text) gives the query's vector; vectors is a table of
    sentence, embedding; sentences a table of doc_id, pos, sentence."""

    def __init__(self, search: Search, vectors_: DataFrame, sentences: DataFrame, embed: Callable[[str], Sequence[float]]):
        self.search, self.vectors, self.sentences, self.embed = search, vectors_, sentences, embed

    def best(self, scope: DataFrame, query: Sequence[float]) -> DataFrame:
        """doc_id, score, pos of each meeting's best sentence: scores are made once a sentence and joined back."""
        key = self.search.doc_id
        inside = self.sentences.join(scope.select(key), key, "left_semi")
        scores = vectors.scored(self.vectors.join(inside.select("sentence").distinct(), "sentence", "left_semi"), query).select("sentence", "score")
        return vectors.best_per(inside.join(scores, "sentence"), key, "score", "pos")

    def retrieve(self, question: str, mentions: Sequence[R.Mention] = (), k: int = DEFAULT) -> Evidence:
        """Without words to embed the lexical listing; any outcome without evidence as it is; without an embedder's
        answer the lexical hits, said so in status."""
        key = self.search.doc_id
        lexical = self.search.retrieve(question, mentions, k=MOST)
        names = [m.text for m in mentions if m.resolution.canonical]
        text = routing.semantic_text(question, names)
        if not text or lexical.outcome not in ("ok", "no_lexical_match") or lexical.method != "bm25":
            lexical.hits = lexical.hits[:k]
            return lexical
        try:
            query = self.embed(text)
        except Exception as e:  # whatever the embedder's failure is, the words still answer
            lexical.status, lexical.hits = f"lexical_only:{type(e).__name__}", lexical.hits[:k]
            return lexical
        scope = self.search.scope(R.gate(mentions, "meetings", search=True).constraints, lexical.asked.day)
        semantic = vectors.depth(self.best(scope, query), "score", "semantic_rank").withColumnRenamed("score", "similarity")
        spark = scope.sparkSession
        words = spark.createDataFrame([(h[key], h["rank"]) for h in lexical.hits], f"{key} {scope.schema[key].dataType.simpleString()}, lexical_rank int") if lexical.hits else scope.select(key, F.lit(None).cast("int").alias("lexical_rank")).where("false")
        fused = vectors.fused(words, semantic, key).join(scope.select(key, "day"), key)
        ranked = fused.orderBy(F.desc("rrf"), F.asc_nulls_last("lexical_rank"), F.desc("day"), key).limit(k)
        kept = vectors.selected(ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), F.asc_nulls_last("lexical_rank"), F.desc("day"), key))))
        rows = kept.join(self.sentences, [key, "pos"], "left").orderBy("rank").collect()
        said = {h[key]: h for h in lexical.hits}
        hits = [said.get(r[key], {key: r[key], "day": r["day"]}) | {"rank": i, "rrf": r["rrf"], "lexical_rank": r["lexical_rank"], "semantic_rank": r["semantic_rank"], "snippet": merged_snippet(said.get(r[key], {}).get("snippet", ""), r["sentence"] or "", r["similarity"] or 0.0)} for i, r in enumerate(rows, 1)]
        return Evidence("ok" if hits else lexical.outcome, hits, lexical.filtered, lexical.matched, lexical.fewer_than_k, "rrf", lexical.asked, lexical.notes, "hybrid")
