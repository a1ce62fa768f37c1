"""Conversations, retrieval context, and answers from a pluggable language model client."""

from __future__ import annotations

import json
import re
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomveil.functions import columns as c
from loomveil.functions import fixed as fx

DEFAULT_TITLE = "Nieuw gesprek"
#: What a model is told where the caller gives no prompt.
BASE_PROMPT = """Je helpt met vragen over de documenten van de gebruiker.
Baseer je antwoord alleen op de context hieronder en verzin niets.
Zeg het eerlijk als de context geen antwoord geeft.
Gebruik de taal van de vraag."""
CONTEXT_OPEN, CONTEXT_CLOSE = "--- DOCUMENT CONTEXT ---", "--- EINDE CONTEXT ---"


class LoomveilError(Exception):
    """An error with a code."""

    code = "ERROR"


class DocumentError(LoomveilError):
    code = "DOCUMENT_ERROR"


class SearchError(LoomveilError):
    code = "SEARCH_ERROR"


class ModelError(LoomveilError):
    code = "LLM_ERROR"


class StorageError(LoomveilError):
    code = "STORAGE_ERROR"


# --- conversations as DataFrames -----------------------------------------------------------


def with_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its messages in order, as an array; none is an empty array."""
    ordered = F.sort_array(F.collect_list(F.struct("created_at", "seq", "role", "content")))
    grouped = messages.groupBy("conversation_id").agg(ordered.alias("messages"))
    out = conversations.join(grouped.withColumnRenamed("conversation_id", "id"), "id", "left")
    return out.withColumn("messages", F.coalesce("messages", F.array().cast(grouped.schema["messages"].dataType)))


def last_messages(messages: DataFrame, n: int = 10, key: str = "conversation_id", order: tuple[str, ...] = ("created_at", "seq")) -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy(key).orderBy(*(F.desc(x) for x in order))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def create_conversations(requests: DataFrame) -> DataFrame:
    """Rows (id, title, document_ids, now) as conversations; a missing title is the default."""
    return requests.select("id", F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"), F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"), F.col("now").alias("created_at"), F.col("now").alias("updated_at"))


def update_conversations(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, title, document_ids, now); null fields stay, and any change moves updated_at."""
    new = changes.select("id", F.col("title").alias("n_title"), F.col("document_ids").alias("n_ids"), "now")
    return conversations.join(new, "id", "left").select("id", F.coalesce("n_title", "title").alias("title"), F.coalesce("n_ids", "document_ids").alias("document_ids"), "created_at", F.coalesce("now", "updated_at").alias("updated_at"))


def append_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with new ones, and conversations whose updated_at follows them."""
    latest = new.groupBy("conversation_id").agg(F.max("created_at").alias("now")).withColumnRenamed("conversation_id", "id")
    moved = conversations.join(latest, "id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("now", "updated_at"))).drop("now")
    return moved, messages.unionByName(new, allowMissingColumns=True)


def delete_conversations(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the conversations in `ids` (id)."""
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def context_text(results: DataFrame, name: str = "name") -> DataFrame:
    """One row with the context of search results, best first: numbered sources parted by rules."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "chunk_id", name, "content")))
    one = lambda x, i: F.concat(F.lit("[Bron "), (i + 1).cast("string"), F.lit(": "), x[name], F.lit("]\n"), x["content"])
    return results.agg(F.array_join(F.transform(ranked, one), "\n\n---\n\n").alias("context"))


def sources_of(results: DataFrame, name: str = "name") -> DataFrame:
    return results.select("chunk_id", "document_id", F.col(name).alias("document_name"), "content", "score")


def system_prompt(context: Column, custom: Column | None = None) -> Column:
    base = F.coalesce(custom, F.lit(BASE_PROMPT)) if custom is not None else F.lit(BASE_PROMPT)
    return F.when(F.coalesce(context, F.lit("")) == "", base).otherwise(F.concat(base, F.lit(f"\n\n{CONTEXT_OPEN}\n"), context, F.lit(f"\n{CONTEXT_CLOSE}")))


# --- language model clients ----------------------------------------------------------------


@dataclass(frozen=True)
class ModelConfig:
    provider: str = "ollama"  # or "openai"
    base_url: str = "http://localhost:11434"
    model: str = "llama3.2"
    timeout: float = 120.0
    api_key: str | None = None
    temperature: float = 0.7
    max_tokens: int = 1024

    def public(self) -> dict:
        """For display: the key is masked."""
        return self.__dict__ | {"api_key": "********" if self.api_key else None}

    def saved_over(self, stored: ModelConfig) -> ModelConfig:
        """What to store: a masked or empty key keeps the stored one."""
        return self if self.api_key and set(self.api_key) != {"*"} else ModelConfig(**self.__dict__ | {"api_key": stored.api_key})


@dataclass(frozen=True)
class Delta:
    content: str
    done: bool


def ndjson_deltas(reads: Iterable[bytes]) -> Iterator[Delta]:
    """Deltas of newline-delimited JSON; lines may be cut anywhere between reads."""
    for line in _lines(reads):
        try:
            x = json.loads(line)
        except ValueError:
            continue
        yield Delta((x.get("message") or {}).get("content", ""), bool(x.get("done")))


def sse_deltas(reads: Iterable[bytes]) -> Iterator[Delta]:
    """Deltas of server-sent events, to [DONE] or a finish reason."""
    for line in _lines(reads):
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            yield Delta("", True)
            return
        try:
            choice = (json.loads(data).get("choices") or [{}])[0]
        except ValueError:
            continue
        yield Delta((choice.get("delta") or {}).get("content") or "", choice.get("finish_reason") is not None)


def _lines(reads: Iterable[bytes]) -> Iterator[str]:
    rest = b""
    for r in reads:
        *whole, rest = (rest + r).split(b"\n")
        yield from (x.decode("utf-8", "replace").strip() for x in whole)
    yield rest.decode("utf-8", "replace").strip()


class HttpModel:
    """A chat model behind HTTP; `opener` sends a request and gives the response's reads."""

    def __init__(self, config: ModelConfig, opener: Callable[[urllib.request.Request, float], Iterable[bytes]] | None = None):
        self.config = config
        self.opener = opener or (lambda request, timeout: urllib.request.urlopen(request, timeout=timeout))  # noqa: S310

    def stream(self, messages: list[dict], system: str = "") -> Iterator[Delta]:
        cfg, said = self.config, [*([{"role": "system", "content": system}] if system else []), *messages]
        if cfg.provider == "openai":
            path, body, read = "/v1/chat/completions", {"model": cfg.model, "messages": said, "stream": True, "temperature": cfg.temperature, "max_tokens": cfg.max_tokens}, sse_deltas
        else:
            path, body, read = "/api/chat", {"model": cfg.model, "messages": said, "stream": True, "options": {"temperature": cfg.temperature, "num_predict": cfg.max_tokens}}, ndjson_deltas
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {cfg.api_key}"} if cfg.api_key else {})
        request = urllib.request.Request(cfg.base_url.rstrip("/") + path, json.dumps(body).encode(), headers)  # noqa: S310
        try:
            for d in read(self.opener(request, cfg.timeout)):
                yield d
                if d.done:
                    return
        except OSError as e:
            raise ModelError(f"model is not reachable: {e}") from e

    def available(self) -> bool:
        path = "/v1/models" if self.config.provider == "openai" else "/api/tags"
        try:
            list(self.opener(urllib.request.Request(self.config.base_url.rstrip("/") + path), 5.0))  # noqa: S310
        except OSError:
            return False
        return True


class EchoModel:
    """An offline stand-in: answers with the last message, word by word."""

    def stream(self, messages: list[dict], system: str = "") -> Iterator[Delta]:
        for w in messages[-1]["content"].split():
            yield Delta(w + " ", False)
        yield Delta("", True)

    def available(self) -> bool:
        return True


def answer(model, question: str, results: DataFrame, history: DataFrame | None = None, custom: str | None = None, name: str = "name", repeat_question: bool = False) -> tuple[Iterator[Delta], list]:
    """Stream an answer to `question` from search results and earlier messages; also its sources.

    Results and history are a few rows (top-k and last n). repeat_question keeps the
    question twice where history already ends with it.
    """
    rows = sources_of(results, name).collect()
    text = context_text(results, name).first()["context"] if rows else ""
    system = custom or BASE_PROMPT
    system += f"\n\n{CONTEXT_OPEN}\n{text}\n{CONTEXT_CLOSE}" if text else ""
    past = [{"role": r["role"], "content": r["content"]} for r in history.orderBy("created_at", "seq").collect()] if history is not None else []
    ask = {"role": "user", "content": question}
    messages = past if past[-1:] == [ask] and not repeat_question else [*past, ask]
    return model.stream(messages, system), rows


def title_of(question: Column) -> Column:
    return c.title_of(question)


def say(model, question: str, conversation: DataFrame, messages: DataFrame, results: DataFrame, now: Column, history: int = 10, custom: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """One turn of a conversation (one row): conversations and messages after it, and the answer's text.

    The question and the answer with its sources become messages; the first question of a
    conversation becomes its title. What is collected is one question's: the k best results,
    the last `history` messages and the answer.
    """
    spark, row = conversation.sparkSession, conversation.select("id", "title").first()
    own = messages.where(F.col("conversation_id") == row.id)
    past = last_messages(own, history)
    deltas, sources = answer(model, question, results, past if history else None, custom)
    text = "".join(d.content for d in deltas)
    first = (own.agg(F.max("seq")).first()[0] or 0) + 1
    found = [{"chunk_id": str(s.chunk_id), "document_id": str(s.document_id), "document_name": s.document_name, "content": s.content, "score": float(s.score)} for s in sources]
    kind = "conversation_id string, seq int, role string, content string, sources array<struct<chunk_id:string,document_id:string,document_name:string,content:string,score:double>>"
    new = spark.createDataFrame([(row.id, first, "user", question, None), (row.id, first + 1, "assistant", text, found)], kind).withColumn("created_at", now)
    moved, every = append_messages(conversation, messages, new)
    title = F.when((F.lit(first) == 1) & (F.col("title") == DEFAULT_TITLE), title_of(F.lit(question))).otherwise(F.col("title"))
    return moved.withColumn("title", title), every, text


#: What `converse` gives for each question: the question and the answer, and how many earlier messages the model saw.
TURN = "seq bigint, role string, content string, seen int, title string"


class Talk:
    """A conversation's last messages, from which the next question is answered."""

    def __init__(self, model, history: int, past: Iterable[tuple[str, str]] = (), asked: int = 0):
        self.model, self.past, self.asked = model, deque(past, maxlen=history), asked

    def turn(self, question: str | None, context: str | None = None) -> list[tuple]:
        """Rows of TURN for a question; the first of a conversation gives its title."""
        question = question or ""
        messages = [*({"role": r, "content": x} for r, x in self.past), {"role": "user", "content": question}]
        system = BASE_PROMPT + (f"\n\n{CONTEXT_OPEN}\n{context}\n{CONTEXT_CLOSE}" if context else "")
        text = "".join(d.content for d in self.model.stream(messages, system))
        self.asked += 1
        at, seen = 2 * self.asked - 1, len(messages) - 1
        self.past.extend((("user", question), ("assistant", text)))
        return [(at, "user", question, seen, title_text(question) if self.asked == 1 else None), (at + 1, "assistant", text, seen, None)]


def title_text(question: str) -> str:
    """title_of() of one question."""
    t = re.sub(f"[{fx.WS}]+", " ", question).strip(" ")
    return t if len(t) <= 50 else t[:47] + "..."


def converse(questions: DataFrame, model, history: int = 10, order: str = "seq") -> DataFrame:
    """Answer the questions (conversation_id, `order`, content, and context if there is one) of any number of conversations.

    Gives conversation_id and TURN. Conversations are dealt to tasks and each goes on in its order, as an answer is part of
    the next question's history; a task holds the last `history` messages of one conversation. The model goes to the
    executors, so it has to be picklable. A null question is an empty one; a null id is a conversation of its own.
    """
    with_context = "context" in questions.columns
    kind = questions.schema["conversation_id"].dataType.simpleString()
    rows = questions.select("conversation_id", order, "content", *(["context"] if with_context else []))
    dealt = rows.repartition("conversation_id").sortWithinPartitions("conversation_id", order, "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        talk, of = None, object()
        for batch in batches:
            ids = batch["conversation_id"].astype(object).where(batch["conversation_id"].notna(), None)
            out = []
            for i, question, context in zip(ids, batch["content"], batch["context"] if with_context else repeat(None), strict=with_context):
                if talk is None or i != of:
                    talk, of = Talk(model, history), i
                out += [(i, *row) for row in talk.turn(question, context)]
            yield pd.DataFrame(out, columns=["conversation_id", "seq", "role", "content", "seen", "title"])

    return dealt.mapInPandas(run, f"conversation_id {kind}, {TURN}")


def answer_text(model, question: str, results: DataFrame, **options) -> str:
    """The whole answer at once."""
    return "".join(d.content for d in answer(model, question, results, **options)[0])


#: Names of older callers, who speak of sessions.
create_sessions, update_sessions, delete_sessions, session_messages, append_to_session = create_conversations, update_conversations, delete_conversations, with_messages, append_messages
