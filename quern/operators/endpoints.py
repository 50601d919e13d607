"""Driver-side settings of model services: weighted endpoints with cool-down, and a bounded answer cache."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path


def normal_url(url: str) -> str:
    """With a scheme, without a slash at the end."""
    url = url.strip().rstrip("/")
    return url if "://" in url else f"http://{url}"


def read_endpoints(path: str) -> dict[str, float]:
    """Weights by URL from JSON (a list, or groups of lists) or a text of one URL, and maybe a weight, in each line."""
    text = Path(path).read_text()
    try:
        found = json.loads(text)
    except ValueError:
        rows = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
        return {normal_url(r[0]): float(r[1]) if len(r) > 1 else 1.0 for r in rows}
    items = [x for group in found.values() for x in group] if isinstance(found, dict) else found
    return {normal_url(x["url"] if isinstance(x, dict) else x): float(x.get("weight", 1)) if isinstance(x, dict) else 1.0 for x in items}


@dataclass
class EndpointPool:
    """Picks endpoints by smooth weighted rotation; one that fails three times in a row rests for 30 seconds."""

    weights: dict[str, float]
    failures: int = 3
    rest: float = 30.0
    now: Callable[[], float] = time.monotonic
    credit: dict[str, float] = field(default_factory=dict)
    failed: dict[str, int] = field(default_factory=dict)
    until: dict[str, float] = field(default_factory=dict)

    def pick(self) -> str:
        up = {u: w for u, w in self.weights.items() if w > 0 and self.until.get(u, 0) <= self.now()}
        if not up:
            raise RuntimeError("no endpoint is available")
        for u, w in up.items():
            self.credit[u] = self.credit.get(u, 0.0) + w
        best = max(up, key=lambda u: self.credit[u])
        self.credit[best] -= sum(up.values())
        return best

    def report(self, url: str, ok: bool) -> None:
        self.failed[url] = 0 if ok else self.failed.get(url, 0) + 1
        if self.failed[url] >= self.failures:
            self.until[url], self.failed[url] = self.now() + self.rest, 0


def canonical_hash(value: object) -> str:
    """sha-256 of a value's JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class AnswerCache:
    """The most recently used answers, a bounded number."""

    def __init__(self, most: int = 8192):
        self.most, self.items = most, OrderedDict()

    def get(self, key: str):
        if key in self.items:
            self.items.move_to_end(key)
            return self.items[key]
        return None

    def put(self, key: str, value: object) -> None:
        self.items[key] = value
        self.items.move_to_end(key)
        while len(self.items) > self.most:
            self.items.popitem(last=False)
