"""Plain-Python restatements of the rules, for brute-force comparison."""

import hashlib
import hmac
import re

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def b62(n):
    out = ""
    while True:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
        if n == 0:
            return out


def number(s):
    n = 0
    for c in s:
        n = n * 62 + DIGITS.index(c)
    return n


def tag(key_hex, n):
    digest = hmac.new(bytes.fromhex(key_hex), n.to_bytes(4, "little"), hashlib.sha256).digest()
    return int.from_bytes(digest[:4], "little")


def scope_key(secret_hex, scope):
    return hmac.new(bytes.fromhex(secret_hex), scope.encode(), hashlib.sha256).hexdigest()


def sentinel(ty, n, t):
    return f"⟦S{':' + ty if ty else ''}·{b62(n)}·{b62(t)}⟧"


def rehydrate(text, vault, key_hex):
    """Byte-wise reading with a 64-byte window, then a verbatim flush."""
    buf, out, i = text.encode(), b"", 0
    mark, close = "⟦S".encode(), "⟧".encode()
    while True:
        p = buf.find(mark, i)
        if p < 0:
            return (out + buf[i:]).decode()
        out += buf[i:p]
        window = buf[p : p + 64]
        end = window.find(close)
        m = None
        if end >= 0:
            m = re.search("·([0-9A-Za-z]+)·([0-9A-Za-z]+)$".encode(), window[len(mark) : end])
        if m and max(number(m[1].decode()), number(m[2].decode())) < 2**32:
            n, t = number(m[1].decode()), number(m[2].decode())
            whole = window[: end + len(close)]
            real = n in vault and n != 2**32 - 1 and tag(key_hex, n) == t
            out += vault[n].encode() if real else whole
            i = p + len(whole)
        elif len(buf) - p >= 64:
            out += buf[p : p + 1]
            i = p + 1
        else:
            return (out + buf[p:]).decode()


def resolve(candidates):
    order = sorted(range(len(candidates)), key=lambda k: (-candidates[k][2], candidates[k][0] - candidates[k][1], candidates[k][0], k))
    kept = []
    for k in order:
        s, e, _ = candidates[k]
        if all(e <= a or b <= s for a, b, _ in kept):
            kept.append(candidates[k])
    return sorted(kept)


def literals(text, terms):
    """Leftmost-longest, non-overlapping."""
    out, i = [], 0
    while i < len(text):
        hit = max((t for t in terms if text.startswith(t, i)), key=len, default=None)
        if hit is None:
            i += 1
        else:
            out.append((i, i + len(hit)))
            i += len(hit)
    return out
