"""Providers answer for rows where a model would: a label, a yes or no, a score.

The one that is tested is deterministic and works offline, by words. Others implement the same
methods over batches of texts; they run on the executors in pandas UDFs, cost nothing where
no row needs them, and give None where they fail.
"""

from __future__ import annotations

import json
import os
import queue
import re
import threading
import urllib.request
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import bound


class Provider(Protocol):
    def holds(self, texts: Sequence[str], condition: str) -> list[bool | None]: ...

    def label(self, texts: Sequence[str], labels: Sequence[str]) -> list[str | None]: ...

    def score(self, texts: Sequence[str], question: str) -> list[float | None]: ...

    def complete(self, prompt: str) -> str: ...


#: Words of praise and blame of the offline provider.
PRAISE = ("good", "great", "excellent", "love", "best", "happy", "positive", "wonderful", "enjoy")
BLAME = ("bad", "terrible", "awful", "hate", "worst", "sad", "negative", "poor", "stupid", "loser", "pathetic", "scum")
#: Words that say nothing about what a condition is about.
PLAIN = frozenset("a an and are as at be by for from has have in is it its mention mentions about of on or rows row text texts that the their them to was were which with where who find show keep all".split())


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class OfflineProvider:
    """Answers by the words in a text and nothing else."""

    def holds(self, texts: Sequence[str], condition: str) -> list[bool | None]:
        """Whether a text has every word of the condition that says something."""
        wanted = {w for w in words(condition) if w not in PLAIN}
        return [None if t is None else bool(wanted) and wanted <= set(words(t)) for t in texts]

    def column(self, text: Column, condition: str) -> Column | None:
        """The same as an expression."""
        wanted = sorted({w for w in words(condition) if w not in PLAIN})
        have = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
        return bound(have, lambda ws: F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(ws, w))) if wanted else F.when(text.isNotNull(), F.lit(False))

    def label(self, texts: Sequence[str], labels: Sequence[str]) -> list[str | None]:
        """The label that occurs most, the first of equals; for positive, negative, neutral by praise and blame; None without any."""
        out: list[str | None] = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            ws = words(t)
            if set(labels) <= {"positive", "negative", "neutral"}:
                s = sum(w in PRAISE for w in ws) - sum(w in BLAME for w in ws)
                got = "positive" if s > 0 else "negative" if s < 0 else "neutral"
                out.append(got if got in labels else None)
            else:
                counts = [ws.count(x.lower()) for x in labels]
                out.append(labels[counts.index(max(counts))] if labels and max(counts) else None)
        return out

    def score(self, texts: Sequence[str], question: str) -> list[float | None]:
        """Share of the question's words that a text has."""
        wanted = [w for w in dict.fromkeys(words(question)) if w not in PLAIN]
        return [None if t is None else sum(w in set(words(t)) for w in wanted) / len(wanted) if wanted else 0.0 for t in texts]

    def complete(self, prompt: str) -> str:
        raise NotImplementedError("the offline provider writes no text")


class CallableProvider(OfflineProvider):
    """A function from prompt to text as provider; each text is asked for alone and whole, a failure is None."""

    column = None  # a model's answer is no expression

    def __init__(self, ask: Callable[[str], str], tries: int = 3):
        self.ask, self.tries = ask, tries

    def complete(self, prompt: str) -> str:
        for left in range(self.tries - 1, -1, -1):
            try:
                return self.ask(prompt)
            except Exception:
                if not left:
                    raise
        raise AssertionError

    def _each(self, texts: Sequence[str], make: Callable[[str], str], read: Callable[[str], object]) -> list:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else read(self.complete(make(t))))
            except Exception:  # noqa: BLE001  a row that can't be answered for is null, not the end of the job
                out.append(None)
        return out

    def holds(self, texts, condition):
        return self._each(texts, lambda t: f"Does this satisfy: {condition}? Answer YES or NO.\n{t}", lambda a: a.strip().upper().startswith("Y"))

    def label(self, texts, labels):
        return self._each(texts, lambda t: f"Choose one of {', '.join(labels)} for this text; answer with it alone.\n{t}", lambda a: next((x for x in labels if x.lower() in a.lower()), None))

    def score(self, texts, question):
        return self._each(texts, lambda t: f"How relevant is this to: {question}? Answer with a number from 0 to 1.\n{t}", lambda a: float(re.search(r"\d*\.?\d+", a)[0]))


class HttpProvider(CallableProvider):
    """A chat model behind a URL that takes ``model`` and ``messages`` and answers with ``choices`` and ``usage``.

    ``seconds`` bounds a question with all its tries; ``used`` sums the tokens that this process's calls report. The key is read
    from the environment variable ``key_name`` where a call is made, so that it is never part of a plan.
    """

    def __init__(self, url: str, model: str, key_name: str = "MODEL_API_KEY", seconds: float = 100.0, tries: int = 3):
        super().__init__(self._post, tries)
        self.url, self.model, self.key_name, self.seconds = url, model, key_name, seconds
        self.used = {"prompt_tokens": 0, "completion_tokens": 0}

    def _post(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[self.key_name]}"} if self.key_name in os.environ else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.seconds) as answer:
            got = json.load(answer)
        for name in self.used:
            self.used[name] += int((got.get("usage") or {}).get(name, 0))
        return got["choices"][0]["message"]["content"]

    def complete(self, prompt: str) -> str:
        """The answer; TimeoutError when the time is up, however the server trickles."""
        got: queue.Queue = queue.Queue()

        def work() -> None:
            try:
                got.put((CallableProvider.complete(self, prompt), None))
            except Exception as e:  # noqa: BLE001  raised again by the caller
                got.put((None, e))

        threading.Thread(target=work, daemon=True).start()
        try:
            text, error = got.get(timeout=self.seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer in {self.seconds} s") from None
        if error:
            raise error
        return text


def as_column(provider: Provider, text: Column, condition: str) -> Column | None:
    """The answer as an expression, where a provider has one for the condition (``column``); no row goes to Python then."""
    make = getattr(provider, "column", None)
    return make(text, condition) if make else None


def holds(provider: Provider, text: Column, condition: str) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(provider.holds([None if pd.isna(x) else x for x in s], condition), dtype="boolean")

    return run(text)


def label(provider: Provider, text: Column, labels: Sequence[str]) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(provider.label([None if pd.isna(x) else x for x in s], labels), dtype=object)

    return run(text)


def score(provider: Provider, text: Column, question: str) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(provider.score([None if pd.isna(x) else x for x in s], question), dtype="float64")

    return run(text)


def read_json(text: str) -> object:
    """The first JSON value in a model's answer, fences and words around it aside; ValueError without one."""
    text = re.sub(r"```\w*", "", text)
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.JSONDecoder().raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
    raise ValueError("no JSON in the answer")
