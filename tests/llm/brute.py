"""Plain Python versions of the operators, for small tables of dicts."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

import xxhash

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    for kind, pattern in BASE_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),  # noqa: B023
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                spans.append((kind, m.start(), m.end()))
    return spans


def base_digest(text: str) -> tuple[int, int, int, int, str]:
    spans = base_spans(text)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    counts = [sum(k == kind for k, _, _ in spans) for kind in BASE_PATTERNS]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())


def fingerprint(text: str) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(A_TO_Z)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], ids: list[int | None]) -> list[int | None]:
    """For each fingerprint the smallest id reachable over links of at most 3 bits."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    least: dict[int, int | None] = {}
    for i, doc_id in enumerate(ids):
        r = find(i)
        known = [x for x in (least.get(r), doc_id) if x is not None]
        least[r] = min(known) if known else None
    return [least[find(i)] for i in range(len(prints))]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
