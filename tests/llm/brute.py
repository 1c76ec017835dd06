"""Plain Python forms of the operators' contracts, row by row."""

import hashlib
import re
import zlib

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def secrets(text):
    """(counts, base spans) of one text; only ASCII letters fold."""
    text = (text or "").replace("ſ", "Ā").replace("K", "Ā")
    found = [
        [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        [("access", m) for m in ACCESS.finditer(text) if len(m[0]) >= 20],
        [("hex", m) for m in HEX.finditer(text) if len(m[0]) >= 24],
    ]
    spans = sorted((m.start(), k, m.end(), kind) for k, part in enumerate(found) for kind, m in part)
    return [len(p) for p in found], [f"{kind}:{a}:{b}" for a, _, b, kind in spans]


def secret_row(doc_id, text):
    counts, spans = secrets(text)
    return (doc_id, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def shards(rows, n=40, overhead=16):
    """{(doc_id, size, crc, shard, slot)} in the order of (crc, id)."""
    sized = sorted(((zlib.crc32((t or "").encode()), i, len((t or "").encode()) + overhead) for i, t in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    total, at, out, slots = sum(r[2] for r in sized), 0, [], {}
    for crc, i, size in sized:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        at += size
        out.append((i, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
    return out
