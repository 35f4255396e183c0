"""Models behind protocols, and what protects calls to them.

Embedders and rerankers are plain callables over batches; the Column helpers
load one per worker. Model files are optional: without them, a deterministic
hash embedder and the no-op reranker stand in.
"""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


class Embedder(Protocol):
    def __call__(self, texts: list[str], is_query: bool) -> np.ndarray: ...


class Reranker(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


def l2_normalised(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m.astype(np.float64) ** 2).sum(-1, keepdims=True))
    return np.where(norm > 1e-9, m / np.where(norm > 1e-9, norm, 1), m)


def half_precision(m: np.ndarray) -> np.ndarray:
    """Rounded to IEEE half precision, as vectors are stored."""
    return m.astype(np.float16).astype(np.float32)


class HashEmbedder:
    """Unit vectors from hashed words: equal texts, equal vectors."""

    def __init__(self, dimension: int = 64, query_prefix: str = ""):
        self.dimension, self.query_prefix = dimension, query_prefix

    def __call__(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            for word in re.findall(r"\w+", ((self.query_prefix if is_query else "") + text).lower()):
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                at = int.from_bytes(h[:4], "little") % self.dimension
                out[k, at] += 1.0 if h[4] & 1 else -1.0
            if not out[k].any():
                out[k, 0] = 1.0
        return l2_normalised(out).astype(np.float32)


def model_file(folder: str, precision: str = "fp16") -> str | None:
    """The model of a folder: the half-precision one if it is wanted and there,
    else the full one; None where there is neither."""
    names = ("model_fp16.onnx", "model.onnx") if precision == "fp16" else ("model.onnx", "model_fp16.onnx")
    return next((str(Path(folder) / n) for n in names if (Path(folder) / n).exists()), None)


def model_folder(name: str, override: str | None = None, root: str = "models") -> str:
    """Where a model's files are: ``override`` if it holds any, else below ``root``."""
    if override and model_file(override):
        return override
    return str(Path(root) / name)


class PieceTokenizer:
    """A SentencePiece model with the ids of XLM-R.

    The ids of that family have four special ones first (<s>, <pad>, </s>,
    <unk>), so pieces stand one place later than in the SentencePiece model,
    whose unknown piece 0 becomes <unk>.
    """

    SPECIAL = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    @classmethod
    def remapped(cls, pieces: list[int]) -> list[int]:
        return [cls.SPECIAL["<unk>"] if p == 0 else p + 1 for p in pieces]

    def ids(self, text: str) -> list[int]:
        return self.remapped(self.model.encode(text))

    def token_to_id(self, token: str) -> int:
        return self.SPECIAL[token]


class WordPieceTokenizer:
    """``tokenizer.json`` of a folder, or BERT word pieces from its ``vocab.txt``."""

    def __init__(self, folder: str):
        from tokenizers import BertWordPieceTokenizer, Tokenizer

        whole = Path(folder) / "tokenizer.json"
        if whole.exists():
            self.tokenizer = Tokenizer.from_file(str(whole))
        else:
            self.tokenizer = BertWordPieceTokenizer(str(Path(folder) / "vocab.txt"), lowercase=True)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def token_to_id(self, token: str) -> int:
        return self.tokenizer.token_to_id(token)


class OnnxEmbedder:
    """A sentence embedder from a model file and ``tokenizer.json``."""

    def __init__(
        self, folder: str, query_prefix: str = "", max_tokens: int = 512, batch: int = 32, precision: str = "fp16"
    ):
        import onnxruntime
        from tokenizers import Tokenizer

        self.session = onnxruntime.InferenceSession(model_file(folder, precision))
        self.tokenizer = Tokenizer.from_file(str(Path(folder) / "tokenizer.json"))
        self.tokenizer.enable_truncation(max_tokens)
        self.tokenizer.enable_padding()
        self.query_prefix, self.batch = query_prefix, batch

    def __call__(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        parts = []
        for at in range(0, len(texts), self.batch):
            named = [(self.query_prefix if is_query else "") + t for t in texts[at : at + self.batch]]
            coded = self.tokenizer.encode_batch(named)
            feed = {
                "input_ids": np.array([c.ids for c in coded], np.int64),
                "attention_mask": np.array([c.attention_mask for c in coded], np.int64),
            }
            parts.append(self.session.run(["sentence_embedding"], feed)[0])
        return l2_normalised(np.concatenate(parts)) if parts else np.zeros((0, 0), np.float32)


class OnnxReranker:
    """A cross-encoder; one logit per pair, anything else is an error.

    ``family`` 'bert' has segment ids and 3 special tokens, 'xlm-r' has 4 and
    no segments; the query gets at most half of what remains.
    """

    def __init__(self, folder: str, family: str, max_tokens: int = 512, batch: int = 8):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(model_file(folder, "fp32"))
        pieces = Path(folder) / "sentencepiece.bpe.model"
        self.tokenizer = PieceTokenizer(str(pieces)) if pieces.exists() else WordPieceTokenizer(folder)
        self.family, self.max_tokens, self.batch = family, max_tokens, batch
        self.special = 3 if family == "bert" else 4

    def pair(self, query: list[int], text: list[int]) -> tuple[list[int], list[int]]:
        room = self.max_tokens - self.special
        query = query[: room // 2]
        text = text[: room - len(query)]
        begin, end = ("[CLS]", "[SEP]") if self.family == "bert" else ("<s>", "</s>")
        b, e = self.tokenizer.token_to_id(begin), self.tokenizer.token_to_id(end)
        middle = [e] if self.family == "bert" else [e, e]
        ids = [b, *query, *middle, *text, e]
        return ids, [0] * (len(query) + 1 + len(middle)) + [1] * (len(text) + 1)

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        q = self.tokenizer.ids(query)
        out: list[float] = []
        for at in range(0, len(texts), self.batch):
            pairs = [
                self.pair(q, self.tokenizer.ids(t))
                for t in texts[at : at + self.batch]
            ]
            longest = max(len(p[0]) for p in pairs)
            pad = lambda x: x + [0] * (longest - len(x))
            feed = {
                "input_ids": np.array([pad(p[0]) for p in pairs], np.int64),
                "attention_mask": np.array([pad([1] * len(p[0])) for p in pairs], np.int64),
            }
            if self.family == "bert":
                feed["token_type_ids"] = np.array([pad(p[1]) for p in pairs], np.int64)
            logits = np.asarray(self.session.run(None, feed)[0])
            if logits.size != len(pairs):
                raise ValueError(f"{logits.size} logits for {len(pairs)} pairs")
            out.extend(logits.reshape(-1).tolist())
        return out


def reranker_family(folder: str | None) -> str:
    """'missing', 'xlm-r' or 'bert', by the files in a model folder."""
    if not folder or model_file(folder) is None:
        return "missing"
    if os.path.exists(os.path.join(folder, "sentencepiece.bpe.model")):
        return "xlm-r"
    return "bert" if os.path.exists(os.path.join(folder, "vocab.txt")) else "missing"


def reranker_for(folder: str | None) -> Reranker | None:
    """The reranker of a folder; None stands for the no-op."""
    family = reranker_family(folder)
    return None if family == "missing" else OnnxReranker(str(folder), family)


def embed(c: Column, factory: Callable[[], Embedder], is_query: bool = False) -> Column:
    """Vectors of a text column; the model is built once per worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            vectors = half_precision(model(texts.fillna("").tolist(), is_query))
            yield pd.Series(list(vectors), index=texts.index)

    return run(c)


def rerank_with(factory: Callable[[], Reranker]) -> Callable[[DataFrame], DataFrame]:
    """Scores of hydrated candidates (query_id, chunk_id, text, rerank_text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            scores = pd.Series(0.0, index=pdf.index)
            for query, rows in pdf.groupby("text"):
                scores[rows.index] = model(query, rows["rerank_text"].fillna("").tolist())
            yield pdf[["query_id", "chunk_id"]].assign(rerank_score=scores)

    return lambda candidates: candidates.select(
        "query_id", "chunk_id", "text", "rerank_text"
    ).mapInPandas(run, "query_id bigint, chunk_id bigint, rerank_score double")


def listwise_order(answer: str | None, size: int) -> list[int]:
    """Positions that a judge's answer in letters names, each once.

    A run of exactly ``size`` different letters is taken as it is; otherwise
    letters count where they first stand. Positions left out are not added.
    """
    letters = [chr(ord("A") + k) for k in range(size)]
    text = (answer or "").upper()
    for run in re.findall(r"\b[A-Z](?:[\s,>]*[A-Z])*\b", text):
        named = re.findall("[A-Z]", run)
        if len(named) == size and sorted(named) == letters:
            return [letters.index(x) for x in named]
    named = [x for x in re.findall(r"\b([A-Z])\b", text) if x in letters]
    return [letters.index(x) for x in dict.fromkeys(named)]


def listwise_prompt(query: str, texts: list[str], most: int = 400) -> str:
    """The question to a judge: the query and the candidates' first characters."""
    shown = "\n".join(f"{chr(ord('A') + k)}: {t[:most]}" for k, t in enumerate(texts))
    return f"Query: {query}\n{shown}\nBest first, letters only:"


def rewritten(query: str, rewrite: Callable[[str], str | None]) -> str:
    """A model's rewriting of a query for the dense side, or the query where
    the answer is missing, shorter than 20 characters or the same."""
    try:
        answer = rewrite(query)
    except Exception:  # noqa: BLE001 - a failing model never fails the search
        return query
    answer = (answer or "").strip()
    return answer if len(answer) >= 20 and answer != query else query


class Breaker:
    """Stops calling a failing service for a while."""

    def __init__(self, failures: int = 3, seconds: float = 30, clock: Callable[[], float] = time.monotonic):
        self.limit, self.seconds, self.clock = failures, seconds, clock
        self.failed, self.until = 0, None

    @property
    def open(self) -> bool:
        if self.until is not None and self.clock() >= self.until:
            self.failed, self.until = 0, None
        return self.until is not None

    def succeeded(self) -> None:
        self.failed, self.until = 0, None

    def failure(self) -> None:
        self.failed += 1
        if self.failed >= self.limit and self.until is None:
            self.until = self.clock() + self.seconds


class Cache:
    """A bounded cache; when it is full, the older half goes."""

    def __init__(self, capacity: int = 256):
        self.capacity, self.held = capacity, OrderedDict()

    def get(self, key: str, make: Callable[[], object]) -> object:
        if key not in self.held:
            if len(self.held) >= self.capacity:
                for _ in range(max(1, self.capacity // 2)):
                    self.held.popitem(last=False)
            self.held[key] = make()
        return self.held[key]


class Guarded:
    """A call to a model service behind a breaker and a cache.

    An open breaker and a failing call give None; only answers are kept. Each
    worker that uses it has a breaker and a cache of its own.
    """

    def __init__(self, call: Callable[[str], str | None], breaker: Breaker | None = None, cache: Cache | None = None):
        self.call, self.breaker, self.cache = call, breaker or Breaker(), cache or Cache()

    def __call__(self, text: str) -> str | None:
        if text in self.cache.held:
            return self.cache.get(text, lambda: None)
        if self.breaker.open:
            return None
        try:
            answer = self.call(text)
        except Exception:  # noqa: BLE001 - whatever fails counts against the service
            self.breaker.failure()
            return None
        self.breaker.succeeded()
        return self.cache.get(text, lambda: answer) if answer else answer


def chat_client(url: str, model: str, seconds: float = 10, most_tokens: int = 200) -> Callable[[str], str | None]:
    """A call to a chat-completions service; what the service answers, or an error."""
    import json
    import urllib.request

    def call(text: str) -> str | None:
        body = {
            "model": model, "temperature": 0, "max_tokens": most_tokens,
            "messages": [{"role": "user", "content": text}],
        }
        request = urllib.request.Request(
            url, json.dumps(body).encode(), {"Content-Type": "application/json"}
        )
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return call


def hypothetical_answers(factory: Callable[[], Callable[[str], str | None]]) -> Callable[[Column], Column]:
    """The text to embed instead of a query: a passage that might answer it.

    ``factory`` builds the guarded service once per worker; without an answer
    the query stays as it is.
    """
    ask = "Write a short passage of a manual that answers the question.\n\nQuestion: {}"

    def column(c: Column) -> Column:
        @F.pandas_udf(T.StringType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            service = factory()
            for texts in batches:
                yield texts.map(
                    lambda q: None if q is None else rewritten(q, lambda text: service(ask.format(text)))
                )

        return run(c)

    return column


def listwise_with(factory: Callable[[], Callable[[str], str | None]]) -> Callable[[DataFrame], DataFrame]:
    """Permutations of the first rows of each query, by a judge that never fails.

    The rows (query_id, position, chunk_id, text, rerank_text) of a query are a
    handful, so a group is one prompt. Without a usable answer there is no
    permutation and the order stays.
    """

    def judged(pdf: pd.DataFrame, service: Callable[[str], str | None]) -> list[int]:
        rows = pdf.sort_values("position")
        prompt = listwise_prompt(rows["text"].iloc[0], rows["rerank_text"].fillna("").tolist())
        try:
            order = listwise_order(service(prompt), len(rows))
        except Exception:  # noqa: BLE001 - a failing judge leaves the order
            order = []
        return [int(rows["chunk_id"].iloc[k]) for k in order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = factory()
        for pdf in batches:
            ids = [
                judged(pd.DataFrame(list(rows)), service) for rows in pdf["rows"]
            ]
            yield pd.DataFrame({"query_id": pdf["query_id"], "ids": ids})

    def permutations(head: DataFrame) -> DataFrame:
        row = F.struct("position", "chunk_id", "text", "rerank_text")
        return (
            head.groupBy("query_id")
            .agg(F.collect_list(row).alias("rows"))
            .mapInPandas(run, "query_id bigint, ids array<bigint>")
            .where(F.size("ids") > 0)
        )

    return permutations
