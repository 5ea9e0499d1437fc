"""Words of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Words are polynomials over two prime fields, so that no pattern of bytes makes them collide (modulo 2**64 some do,
#: whatever the base). The primes and the bases.
_FIELDS = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_812_433_253))
#: Bytes hashed in one go; the tables of powers are as long. 256 * 2**31 * _STEP must stay below 2**64.
_STEP = 1 << 18
_tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def lower_table() -> np.ndarray:
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    return to


def class_table(alphanumeric: bool) -> np.ndarray:
    """True for the bytes of words: digits, a-z and all beyond ASCII; or else all but white space."""
    yes = np.zeros(256, bool)
    if alphanumeric:
        yes[0x30:0x3A] = yes[0x61:0x7B] = yes[0x80:] = True
    else:
        yes[:] = True
        yes[0x20] = False
        yes[0x09:0x0E] = False
    return yes


LOWER, ALPHANUMERIC, NOT_SPACE = lower_table(), class_table(True), class_table(False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def find_words(data: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in data (lower-cased bytes), and the index of each one's text. Words end with their text."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = of[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[(at > 0) & (at < n)]
    begins[edge] |= inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] |= inside[edge - 1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(at, first, "right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: two polynomials over prime fields from prefix sums, and the word's length, mixed.

    Two given words of n bytes have equal hashes with a likelihood of about (n / 2**31)**2.
    """
    out = np.empty(len(first), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(first):
            lo = first[k]
            to = max(k + 1, int(np.searchsorted(last, lo + _STEP, "right")))
            parts = [_polynomial(data[lo : last[to - 1]], first[k:to] - lo, last[k:to] - lo, field) for field in range(2)]
            out[k:to] = parts[0] << _U(32) | parts[1]
            k = to
        return mix(out ^ mix((last - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def _polynomial(data: np.ndarray, first: np.ndarray, last: np.ndarray, field: int) -> np.ndarray:
    """The sum of (byte + 1) * base**(n - 1 - place) of each word of n bytes, in the field."""
    prime, base = _U(_FIELDS[field][0]), _FIELDS[field][1]
    if len(data) > _STEP:  # one long word, in pieces: Horner's rule
        total = _U(0)
        for at in range(0, len(data), _STEP):
            part = data[at : at + _STEP]
            total = (total * _U(pow(base, len(part), int(prime))) + _polynomial(part, np.zeros(1, np.int64), np.array([len(part)]), field)[0]) % prime
        return np.array([total], np.uint64)
    if field not in _tables:
        _tables[field] = [_powers(base, int(prime)), _powers(pow(base, -1, int(prime)), int(prime))]
    down, up = _tables[field][1], _tables[field][0]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + _U(1)) * down[: len(data)], out=sums[1:])
    return (sums[last] - sums[first]) % prime * up[last - 1] % prime


def _powers(base: int, prime: int) -> np.ndarray:
    """base**k modulo prime for k up to _STEP, by doubling."""
    out = np.ones(_STEP, np.uint64)
    n = 1
    while n < _STEP:
        out[n : 2 * n] = out[:n] * _U(pow(base, n, prime)) % _U(prime)
        n *= 2
    return out


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive words, from the words' hashes; element i is of words i to i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, power = np.zeros(n, np.uint64), _U(0xC2B2AE3D27D4EB4F + 2 * seed)
        for j in range(k):
            total = total * power + mix(words[j : j + n] + _U(seed * 0x51_7C_C1B7 + 1))
        return mix(total + _U(k))


def same_text(of: np.ndarray, k: int) -> np.ndarray:
    """True where k consecutive words lie in one text."""
    n = len(of) - k + 1
    return of[:n] == of[k - 1 :] if n > 0 else np.zeros(0, bool)
