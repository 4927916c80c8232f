"""Model and embedding providers: interfaces, a deterministic stand-in, and the checks on what models return.

Everything else works without a provider. A provider is a picklable callable over a batch of
texts; the stand-in makes pipelines testable offline and is no model.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[str], str]
#: Prefixes of the one family of embedding models that wants them.
QUERY_PREFIX, DOCUMENT_PREFIX, PREFIXED_FAMILY = "search_query: ", "search_document: ", "nomic-embed-text"


def hashed_embedder(dims: int) -> Embedder:
    """Signed feature hashing of words: equal texts get equal unit vectors, texts that share words similar ones."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else np.eye(1, dims)[0]).tolist())
        return out

    return embed


def embedding_input(text: Column, model: str, query: bool = False) -> Column:
    """The text as the model wants it: one family takes a prefix, which is not added twice."""
    if not model.split("/")[-1].split(":")[0].lower().startswith(PREFIXED_FAMILY):
        return text
    prefix = QUERY_PREFIX if query else DOCUMENT_PREFIX
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def embedded(df: DataFrame, id_col: str, text_col: str, embed: Embedder, dims: int) -> DataFrame:
    """(id, vector): vectors of the right length with finite entries; others are null. Null texts give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = embed(frame.iloc[:, 1].tolist())
            good = [v if len(v) == dims and np.isfinite(v).all() else None for v in vectors]
            yield pd.DataFrame({"id": frame.iloc[:, 0], "vector": good})

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint"), text_col)
    return rows.mapInPandas(run, "id bigint, vector array<float>").withColumnRenamed("id", id_col)


def asked(df: DataFrame, id_col: str, prompt_col: str, chat: Chat, tries: int = 2) -> DataFrame:
    """(id, reply, error): a model's answers as JSON text. A reply that holds no JSON object is asked for again; errors stay in their row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in frame.itertuples(index=False):
                reply, error = None, None
                for _ in range(tries):
                    try:
                        reply, error = json.dumps(json_object(chat(prompt))), None
                        break
                    except Exception as e:  # noqa: BLE001 - a failed item must not fail the others
                        error = str(e)[:500]
                rows.append((key, reply, error))
            yield pd.DataFrame(rows, columns=["id", "reply", "error"])

    return df.select(F.col(id_col).cast("bigint"), prompt_col).mapInPandas(run, "id bigint, reply string, error string").withColumnRenamed("id", id_col)


def json_object(text: str) -> dict:
    """The JSON object in a model's reply: inside a fence, or from the first { to the last }; trailing commas are forgiven."""
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        text = m[1]
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no JSON object in the reply")
    return loads_lenient(text[start : end + 1])


def loads_lenient(text: str):
    """json.loads that accepts a comma before a closing bracket outside strings."""
    try:
        return json.loads(text)
    except ValueError:
        out, quoted, escaped = [], False, False
        for i, c in enumerate(text):
            if quoted:
                escaped = c == "\\" and not escaped
                quoted = c != '"' or escaped if c != "\\" else True
            elif c == '"':
                quoted, escaped = True, False
            elif c == "," and re.match(r"\s*[}\]]", text[i + 1 :]):
                continue
            out.append(c)
        return json.loads("".join(out))


def valid_suggestions(replies: DataFrame, pairs: int, types: tuple[str, ...]) -> DataFrame:
    """(id, index, type, explanation, confidence) of replies {"suggestions": [...]}: known type, each index once, confidence in 0..1."""
    schema = "suggestions array<struct<index:int,type:string,explanation:string,confidence:double>>"
    rows = replies.select("id", F.posexplode(F.from_json("reply", schema)["suggestions"]).alias("at", "s")).select("id", "at", "s.*")
    good = rows.where(F.col("index").between(0, pairs - 1) & F.col("type").isin(*types) & F.col("confidence").between(0, 1) & (F.length(F.trim("explanation")) > 0))
    return good.groupBy("id", "index").agg(F.min_by(F.struct("type", "explanation", "confidence"), "at").alias("s")).select("id", "index", "s.*")


def valid_answer(reply: Column, context_ids: Column) -> Column:
    """struct(answer, cited): the answer and its distinct citations in order; null if empty or citing outside the context."""
    parsed = F.from_json(reply, "answer string, citations array<bigint>")
    cited = F.array_distinct(parsed["citations"])
    good = (F.length(F.trim(parsed["answer"])) > 0) & (F.size(cited) > 0) & (F.size(F.array_except(cited, context_ids)) == 0)
    return F.when(good, F.struct(F.trim(parsed["answer"]).alias("answer"), cited.alias("cited")))


def valid_findings(replies: DataFrame, context_ids: Column, most: int = 20) -> DataFrame:
    """(id, severity, message, pages): the first `most` model findings whose pages are all in the context."""
    schema = "findings array<struct<severity:string,message:string,pageIds:array<bigint>>>"
    rows = replies.select("id", F.posexplode(F.slice(F.from_json("reply", schema)["findings"], 1, most)).alias("at", "f"), context_ids.alias("ctx"))
    good = F.col("f.severity").isin("error", "warning", "info") & (F.length(F.trim("f.message")) > 0) & (F.size(F.array_except("f.pageIds", "ctx")) == 0)
    return rows.where(good).select("id", F.col("f.severity").alias("severity"), F.trim("f.message").alias("message"), F.col("f.pageIds").alias("pages"))


def completed_decisions(incoming: DataFrame, replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """(incoming_id, action, existing_id): a model's decision for each incoming note, `new` where it gave none or an unknown target.

    replies(incoming_id, action, existing_id), the first of each note counts; candidates(incoming_id, existing_id).
    """
    first = replies.where(F.col("action").isin("new", "merge", "contradict")).groupBy("incoming_id").agg(F.min_by(F.struct("action", "existing_id"), F.struct("action", "existing_id")).alias("d"))
    known = candidates.select("incoming_id", F.col("existing_id").alias("target"), F.lit(True).alias("known"))
    joined = incoming.select("incoming_id").join(first, "incoming_id", "left").select("incoming_id", "d.*")
    checked = joined.join(known, (joined["incoming_id"] == known["incoming_id"]) & (joined["existing_id"] == known["target"]), "left").select(joined["incoming_id"], "action", "existing_id", "known")
    keep = (F.col("action") != "new") & F.coalesce("known", F.lit(False))
    return checked.select("incoming_id", F.when(keep, F.col("action")).otherwise("new").alias("action"), F.when(keep, F.col("existing_id")).alias("existing_id"))
