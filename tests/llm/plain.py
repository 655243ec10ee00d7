"""Plain versions of the operators, for tests."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from math import log, log10

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for j in range(max(1, len(w) - n + 1)):
            if w:
                windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if (s := windows.get(tuple(w[j : j + size]))) is not None:
                    found |= s
                    hit.update(range(j, j + size))
        out.append((key, len(w), len(hit), sorted("" if i is None else str(i) for i in found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def kept_lines(docs, chars=40, least=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= chars:
                holders.setdefault(k, set()).add(i)
    stays = {k: max((i for i in s if i is not None), default=None) for k, s in holders.items() if len(s) >= least}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if stays.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, key * 2862933555777941757 + 1 & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(docs, linked):
    """For each row: its class, as the smallest (key is null, key) and the row numbers; equal texts are together."""
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), (True, 0)), (key is None, key or 0))
    return [(None if least[find(i)][0] else least[find(i)][1], find(i)) for i in range(len(docs))]


def classes(docs, similarity=0.8):
    """Smallest key of each row's connected component by the plain Jaccard similarity."""
    sets = [shingles(t) for _, t in docs]
    return [c for c, _ in components(docs, lambda i, j: jaccard(sets[i], sets[j]) >= similarity)]


def weighted_classes(docs, lift, damp, rare=1000, n=5, similarity=0.8):
    """The components by the weighted Jaccard similarity of TF-IDF shingles, for fewer than `rare` texts."""
    bags = []
    for _, t in docs:
        w = words(t)
        bags.append(Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter())
    df = Counter(x for bag in bags for x in bag)
    weighted = [{x: (1 + damp * log(k)) * (1 + lift * log(len(docs) / df[x]) / log(rare)) for x, k in bag.items()} for bag in bags]

    def linked(i, j):
        a, b = weighted[i], weighted[j]
        shared = sum(min(v, b[x]) for x, v in a.items() if x in b)
        return not a and not b or shared > 0 and shared >= (similarity - 1e-12) * (sum(a.values()) + sum(b.values()) - shared)

    return components(docs, linked)


def base_scores(docs):
    fold = lambda i: 2 if i is None else zlib.crc32(str(i).encode()) % 7
    tokens = [[*TOKEN.findall((t or "").translate(LOW)), None] for _, t in docs]
    count = Counter()
    for (i, _), w in zip(docs, tokens, strict=True):
        if fold(i) != 2:
            count.update(w)
    total, kinds = sum(count.values()), len(count)
    return [(i, fold(i) == 2, len(w), sum(count[x] > 0 for x in w), total, sum(log10((count[x] + 1) / (total + kinds + 1)) for x in w)) for (i, _), w in zip(docs, tokens, strict=True)]


def interpolated(docs, contexts, rounds=60):
    """Deleted interpolation with the estimates as they are: log10 probabilities by key."""
    fold = lambda i: 2 if i is None else zlib.crc32(str(i).encode()) % 7
    tokens = {i: ["<", *TOKEN.findall((t or "").translate(LOW)), ">"] for i, t in docs}

    def counts(left_out):
        train = [w for i, w in tokens.items() if fold(i) not in left_out]
        pairs, context, word = (Counter(x for w in train for x in found(w)) for found in (lambda w: zip(w, w[1:]), lambda w: w[:-1], lambda w: w[1:]))
        n, v = sum(word.values()), len(word)

        def estimates(a, b):
            bucket = min(max(context[a], 0).bit_length(), contexts - 1)
            return bucket, (pairs[a, b] / max(context[a], 1), word[b] / max(n, 1), 1 / (v + 1))

        return estimates

    kept = counts((2, 3))
    seen = Counter(kept(a, b) for i, w in tokens.items() if fold(i) == 3 for a, b in zip(w, w[1:]))
    weights = [[1 / 3] * 3 for _ in range(contexts)]
    weights[0] = [0, 0.5, 0.5]
    for _ in range(rounds):
        sums = [[0.0] * 3 for _ in range(contexts)]
        for (bucket, p), n in seen.items():
            shares = [w * x for w, x in zip(weights[bucket], p)]
            for k in range(3):
                sums[bucket][k] += n * shares[k] / sum(shares)
        total = sum(map(sum, sums[1:]))
        mean = [(sum(s[k] for s in sums[1:]) + 1) / (total + 3) for k in range(3)]
        weights = [[(s[k] + mean[k]) / (sum(s) + 1) for k in range(3)] for s in sums]
        rest = weights[0][1] + weights[0][2]
        weights[0] = [0, weights[0][1] / rest, weights[0][2] / rest]
    every = counts((2,))
    return [(i, sum(log10(sum(w * x for w, x in zip(weights[every(a, b)[0]], every(a, b)[1]))) for a, b in zip(w, w[1:]))) for i, w in tokens.items()]


def unigram(word: bytes, scores):
    """Tokens and score of the best cut, by trying all cuts from the left."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        cuts = [(best[i][0] + scores[word[i:end]], best[i][1] - 1) for i in range(end) if word[i:end] in scores]
        best.append(max(cuts))
    return -best[-1][1], best[-1][0]


def chats(rows):
    """For each conversation: turns, calls, results, links, errors and the messages in order."""
    out = {}
    for conv in {r[0] for r in rows}:
        hashed = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] is not None, r[1] or "", hashed(r[2])))
        tools, asked, errors, messages = None, [], [], []
        for _, role, text in own:
            if role == "system" and "<tools>" in text:
                tools = {t["name"]: t.get("parameters", {}) for t in json.loads(text.split("<tools>")[1].split("</tools>")[0])}
        for k, (_, role, text) in enumerate(own):
            message = {"content": text, "role": role}
            if role == "tool":
                result = json.loads(text)
                message |= {"content": result["content"], "tool_call_id": result["tool_call_id"]}
            if role == "assistant" and "<tool_call>" in text:
                message["content"] = re.sub("(?s)<tool_call>.*?</tool_call>", "", text).strip(" ")
                message["tool_calls"] = []
                for raw in re.findall("(?s)<tool_call>(.*?)</tool_call>", text):
                    try:
                        c = json.loads(raw)
                    except ValueError:
                        c = {"id": None, "name": None, "arguments": {}}
                        found = ["unreadable"]
                    else:
                        found = [] if tools is None or c["name"] in tools else ["unknown_tool"]
                        schema = (tools or {}).get(c["name"], {})
                        found += [f"missing:{a}" for a in schema.get("required", []) if a not in c["arguments"]]
                        found += [f"type:{a}" for a, v in sorted(c["arguments"].items()) if a in schema.get("properties", {}) and not isinstance(v, {"integer": int, "string": str}[schema["properties"][a]["type"]])]
                    asked.append((c["id"], k))
                    message["tool_calls"].append(c)
                    errors += [f"{c['id'] or '?'}:{e}" for e in found]
            messages.append(message)
        first = {}
        for i, k in asked:
            first.setdefault(i, k)
        linked = {k: first[m["tool_call_id"]] for k, m in enumerate(messages) if m["role"] == "tool" and m["tool_call_id"] in first}
        order, rest = [], [*range(len(own))]
        while rest:  # the first message whose call is there already
            k = next(k for k in rest if k not in linked or linked[k] in order)
            order.append(k)
            rest.remove(k)
        ids, results = [i for i, _ in asked if i], [m["tool_call_id"] for m in messages if m["role"] == "tool"]
        found = errors + [f"duplicate:{i}" for i, n in Counter(ids).items() if n > 1] + [f"unlinked:{i}" for i in results if i not in ids] + [f"unanswered:{i}" for i in {*ids} - {*results}]
        out[conv] = len(own), len(asked), len(results), len(linked), sorted(found), [messages[k] for k in order]
    return out
