"""Model calls behind one interface, so plans run offline and tests are deterministic.

A backend maps a batch of prompts to replies. `asked()` runs it where the rows are, in Arrow batches, with bounded retries;
stages that use its replies should be written to a table before they are read twice.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import ship
from verso.plans import prompts


class Backend(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class OfflineBackend:
    """Rules in place of a model: quoted spans are speech, the rest is narration; names are capitalized words before a verb of speech."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.one(p) for p in prompts]

    def one(self, prompt: str) -> str:
        task, body = prompts.split(prompt)
        if task == "CLASSIFY":
            return "NONCONTENT" if re.search("licen[sc]e|copyright|all rights reserved", body[:1000].lower()) else "CONTENT"
        if task == "SCRIPT":
            lines = []
            for k, part in enumerate(re.split(r'["“”]', body.partition(prompts.RULE)[2])):
                if part.strip():
                    lines.append(json.dumps({"speaker_id" if k % 2 else "speaker": "speech" if k % 2 else "narrator", "text": part.strip()}, ensure_ascii=False))
            return "\n".join(lines)
        if task == "CHARACTERS":
            names = dict.fromkeys(re.findall(r"([A-ZÀ-Þ]\w+) (?:said|asked|replied|cried)", body))
            return json.dumps({"characters": {n.lower(): {"name": n, "details": f"{n} speaks."} for n in names}}, ensure_ascii=False)
        if task == "VOICES":
            return json.dumps({i: {"voice": "bm_george" if i == "narrator" else "af_heart", "speed": "1.0"} for i in re.findall(r"(?m)^(\S+): ", body.partition(prompts.RULE)[2])})
        if task == "DEDUP":
            ids = re.findall(r"(?m)^(\S+): ", body)
            parts = {i: set(i.split("_")) - {"the", "don", "dona"} for i in ids}
            groups = {i: [j for j in ids if parts[j] and parts[j] <= parts[i]] for i in ids}
            return json.dumps({"groups": [g for g in groups.values() if len(g) > 1]}, ensure_ascii=False)
        if task == "NARRATOR":
            return json.dumps({"name": "Narrator", "bio": f"Tells {body.partition(chr(10))[0]} calmly."}, ensure_ascii=False)
        if task in ("DESCRIBE", "ACOUSTIC"):
            return f"The voice of {body.splitlines()[-1]}"
        return ""


class RemoteBackend:
    """A chat endpoint over HTTP: posts {model, messages, stream: false} and reads message.content."""

    def __init__(self, url: str, model: str, timeout: float = 300, attempts: int = 5) -> None:
        self.url, self.model, self.timeout, self.attempts = url, model, timeout, attempts

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.one(p) for p in prompts]

    def one(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "stream": False, "messages": [{"role": "user", "content": prompt}]}).encode()
        for attempt in range(1, self.attempts + 1):
            try:
                request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r).get("message", {}).get("content", "")
            except OSError:
                if attempt == self.attempts:
                    raise
                time.sleep(min(5 * attempt, 60))
        return ""


def has_text(reply: str) -> bool:
    return bool(reply.strip())


def has_lines(reply: str) -> bool:
    """Whether some line of a reply is a JSON object."""
    for line in reply.splitlines():
        try:
            if isinstance(json.loads(line), dict):
                return True
        except ValueError:
            pass
    return False


def asked(rows: DataFrame, prompt: str, reply: str, backend: Backend, parallel: int = 0, accept: Callable[[str], bool] | None = None, attempts: int = 1) -> DataFrame:
    """rows with the column `reply`: the backend's answer to the column `prompt`. parallel: at most so many calls at once (0: no limit).

    A reply that `accept` refuses is asked for again, `attempts` times in all; the last one stays.
    """
    ship(rows.sparkSession)
    if parallel:
        rows = rows.repartition(parallel)

    @F.pandas_udf("string")
    def call(x: pd.Series) -> pd.Series:
        asks = [p or "" for p in x]
        replies = backend.answer(asks)
        for _ in range(attempts - 1):
            bad = [i for i, r in enumerate(replies) if accept and not accept(r)]
            if not bad:
                break
            for i, r in zip(bad, backend.answer([asks[i] for i in bad])):
                replies[i] = r
        return pd.Series(replies)

    return rows.withColumn(reply, call.asNondeterministic()(F.col(prompt)))

