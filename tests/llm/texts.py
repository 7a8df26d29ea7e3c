"""Small made-up corpora and brute-force answers for them."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(draw, n, names=300):
    return [f"w{draw.randrange(names)}" for _ in range(n)]


def corpus(seed=1, n=120):
    """(doc_id, text, lang, source): prose, copies, near copies, shared lines, junk, nulls and blanks."""
    draw = random.Random(seed)
    base = [prose(draw, draw.randint(3, 160), 4000) for _ in range(n)]
    rows = []
    for i, w in enumerate(base):
        lines = [" ".join(w[k : k + 20]) for k in range(0, len(w), 20)]
        if i % 7 == 0:
            lines.insert(0, "this very line stands in many of these documents here")
        if i % 9 == 0:
            lines.append("this very line stands in several of these documents here")
        rows.append([i, "\n".join(lines)])
    for i in range(0, n, 5):
        rows.append([n + i, rows[i][1]])
        edited = rows[i][1].split(" ")
        edited[len(edited) // 2] = "changed"
        rows.append([2 * n + i, " ".join(edited)])
    rows += [[5000, None], [5001, ""], [5002, " \n\t "], [5003, "one"], [5004, "One"], [5005, "a b c d"]]
    return [(i, t, ["en", "de", None][i % 3], ["s0", "s1"][i % 2]) for i, t in rows]


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
