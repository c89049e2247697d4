"""Listen addresses: scheme://host:port?count=..&workers=..&blocking=..&queue_size=.., several joined by commas."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs, urlsplit

SCHEMES = ("sflow", "netflow", "flow")
QUEUE = 1_000_000


@dataclass(frozen=True)
class Listener:
    scheme: str
    host: str
    port: int
    sockets: int = 1
    workers: int = 2
    blocking: bool = False
    queue: int = QUEUE


def parse_listeners(text: str) -> list[Listener]:
    out = []
    for part in text.split(","):
        u = urlsplit(part.strip())
        if u.scheme not in SCHEMES:
            raise ValueError(f"{part}: the scheme is one of {', '.join(SCHEMES)}")
        if u.port is None:
            raise ValueError(f"{part}: no port")
        q = {k: v[-1] for k, v in parse_qs(u.query, keep_blank_values=True).items()}
        sockets = int(q.get("count") or 1)
        if sockets < 1:
            raise ValueError(f"{part}: at least one socket")
        blocking = (q.get("blocking") or "false").lower() in ("1", "t", "true")
        workers = int(q.get("workers") or 0) or 2 * sockets
        queue = int(q.get("queue_size") or (0 if blocking else QUEUE))
        out.append(Listener(u.scheme, u.hostname or "", u.port, sockets, workers, blocking, queue))
    return out
