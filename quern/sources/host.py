"""What a collector reads from a Linux host; engines read the files that it writes."""

from __future__ import annotations

import json
import os
import platform
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame


def _numbers(pattern: str, root: str) -> list[float]:
    found = []
    for p in sorted(Path(root).glob(pattern)):
        try:
            found.append(float(p.read_text().strip()))
        except (OSError, ValueError):
            continue
    return found


def sample(root: str = "/", power_paths: tuple[str, ...] = (), power_scale: float = 1.0) -> dict:
    """One telemetry sample; what a host lacks is None. Temperatures above 200 are thousandths."""
    most = lambda xs: max(xs, default=None)
    temperatures = [t / 1000 if t > 200 else t for t in _numbers("sys/class/thermal/thermal_zone*/temp", root)]
    memory = None
    try:
        for line in (Path(root) / "proc/meminfo").read_text().splitlines():
            if line.startswith("MemAvailable:"):
                memory = int(line.split()[1]) / 1024
    except OSError:
        pass
    powers = [x for p in power_paths for x in _numbers(p.lstrip("/"), root)]
    frequency = most(_numbers("sys/devices/system/cpu/cpu[0-9]*/cpufreq/scaling_cur_freq", root))
    return {
        "monotonic_seconds": time.perf_counter(), "temperature_c": most(temperatures), "available_memory_mb": memory, "load_1m": os.getloadavg()[0],
        "power_w": sum(powers) * power_scale if powers else None, "cpu_frequency_mhz": None if frequency is None else frequency / 1000, "cooling_state": most(_numbers("sys/class/thermal/cooling_device*/cur_state", root)),
    }


def device_info() -> dict:
    return {"system": platform.system(), "release": platform.release(), "machine": platform.machine(), "python": platform.python_version(), "logical_cpus": os.cpu_count()}


class LineFramer:
    """Whole lines from a byte stream; what has no line feed yet waits for the rest."""

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> list[bytes]:
        *lines, self.pending = (self.pending + data).split(b"\n")
        return [x.rstrip(b"\r") for x in lines if x.strip()]


def generated(prompts: DataFrame, endpoint: str, max_tokens: int = 256, timeout: float = 120.0, chat: bool = False, model: str = "local") -> DataFrame:
    """(query_id, text, prompt_tokens, generated_tokens, error) from a generation server, one request for each (query_id, prompt).

    Failures are rows with an error, so that a batch is not lost with one request.
    """

    def ask(prompt: str) -> tuple[str, int | None, int | None]:
        body = {"max_tokens": max_tokens, "model": model, "messages": [{"role": "user", "content": prompt}]} if chat else {"n_predict": max_tokens, "prompt": prompt}
        body |= {"temperature": 0.0, "stop": ["</s>", "\n\n问题："]}
        request = urllib.request.Request(endpoint, json.dumps(body, ensure_ascii=False).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            got = json.loads(r.read())
        text = got["choices"][0]["message"]["content"] if chat else got.get("content") or got.get("response") or ""
        if not text.strip():
            raise ValueError("the server returned no text")
        usage, timings = got.get("usage") or {}, got.get("timings") or {}
        return text.strip(), usage.get("prompt_tokens", timings.get("prompt_n")), usage.get("completion_tokens", timings.get("predicted_n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, p in zip(pdf["query_id"], pdf["prompt"], strict=True):
                try:
                    rows.append((q, *ask(p), None))
                except (OSError, ValueError, KeyError, urllib.error.URLError) as e:
                    rows.append((q, None, None, None, str(e)[:2000]))
            yield pd.DataFrame(rows, columns=["query_id", "text", "prompt_tokens", "generated_tokens", "error"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, text string, prompt_tokens bigint, generated_tokens bigint, error string")
