"""Plain single-machine versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(text):
    return zlib.crc32((text or "").encode())


def smallest_capacity(sizes, shards):
    """Smallest largest sum of at most ``shards`` consecutive parts, by trying every cut."""
    best = {0: 0}
    sums = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    for _ in range(shards):
        best = {z: min(max(c, int(sums[z] - sums[a])) for a, c in best.items() if a <= z) for z in range(n + 1)}
    return best[n]


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


NAMES = ("assign", "access", "hex", "account", "key", "endpoint")
WEAK = (
    (3, r"""(?i)\b(?:access_?key_?id|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""),
    (4, r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}"),
    (5, r"""https?://[^\x00-\x20"'<>]+"""))
ROLE = (1, 0, 1, 0, 1, 2)      # identifiers, secrets, endpoints


def linked_spans(text, scope=200):
    """kind:start:end of base parts, and of weak ones beside a base part of another role or beside weak parts of both others, by all pairs."""
    found = base_spans(text)
    found += [(m.start(), k, m.end()) for k, pattern in WEAK for m in re.finditer(pattern, text or "", re.A)]
    place = (0, 0, 0, 1, 3, 2)      # a weak part yields to overlapping ones of an earlier place
    found = [(a, k, z) for a, k, z in found if k < 3 or not any(place[n] < place[k] and b < z and a < y for b, n, y in found)]
    stay = []
    for a, k, z in sorted(found):
        near = [n for b, n, y in found if (0 <= a - y <= scope or 0 <= b - z <= scope) and ROLE[n] != ROLE[k]]
        if k < 3 or min(near, default=9) < 3 or len({ROLE[n] for n in near}) == 2:
            stay.append(f"{NAMES[k]}:{a}:{z}")
    return ",".join(stay)


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    found = words(text)
    windows = collections.Counter(tuple(found[i:i + 5]) for i in range(len(found) - 4))
    covered = set()
    for i in range(len(found) - 4):
        if windows[tuple(found[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def shingles(text, width):
    found = WORD.findall(lowered(text))
    if len(found) < width:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i:i + width]) for i in range(len(found) - width + 1))


def near_components(docs, width, percent):
    """Component of each (id, text) row by comparing all pairs of different sets; its smallest id."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    out = []
    for a in range(len(docs)):
        ids = [docs[b][0] for b in range(len(docs)) if root(b) == root(a) and docs[b][0] is not None]
        out.append(min(ids) if ids else None)
    return out, [len(s) for s in sets]


def byte_removal(texts, length=100):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            string = data[at:at + length]
            if string in seen:
                gone[at:at + length] = True
            seen.add(string)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def span_removal(texts, sentences, least_words=20, least=2):
    """Removed sentences of each text, in order."""
    where = collections.defaultdict(list)
    for d, text in enumerate(texts):
        parts = [s.split() for s in sentences(text)]
        real = [i for i, p in enumerate(parts) if p]
        runs = set()
        for a in range(len(real)):
            total, z = 0, a
            while z < len(real) and (total < least_words or z - a < least):
                total += len(parts[real[z]])
                z += 1
            if total >= least_words and z - a >= least:
                runs.add((a, z))
        for z in range(len(real), 0, -1):
            total, a = 0, z
            while a > 0 and (total < least_words or z - a < least):
                a -= 1
                total += len(parts[real[a]])
            if total >= least_words and z - a >= least:
                runs.add((a, z))
        for a, z in runs:
            where[tuple(" ".join(parts[i]) for i in real[a:z])].append((d, real[a], real[z - 1]))
    gone = [set() for _ in texts]
    for places in where.values():
        for d, a, z in sorted(places)[1:]:
            gone[d].update(range(a, z + 1))
    return gone


def site_lines(rows, ratio=0.1, least=4):
    """Kept lines of each (site, lines) row."""
    pages = collections.Counter(site for site, _ in rows if site is not None)
    on = collections.Counter((site, line) for site, lines in rows if site is not None for line in set(lines) if line)
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    return [[line for line in lines if (site, line) not in bad] for site, lines in rows]


def top_products(vectors, ids, queries, k=10):
    """(query, rank, id, product) of finite vectors as integers."""
    out = set()
    for q in queries:
        products = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -products)) if i != q][:k]
        out |= {(int(ids[q]), r + 1, int(ids[i]), int(products[i])) for r, i in enumerate(order)}
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trie(rows):
    """Sorted node rows of the trie of rebuilt (conv_id, turn, role, text) conversations."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, told + str(len(text.encode())), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children, saved, leaves = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, found in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(found) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    return sorted((v[0], len(k), members[k[:-1]][0] if k else -1, len(v), children[k], leaves[k], saved[k],
                   digest(",".join(str(c) for c in v if rebuilt[c] == k))) for k, v in members.items())
