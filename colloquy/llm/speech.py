"""What a recorder's labels, times and speech mean: pure functions on strings."""

from __future__ import annotations

import re
from collections.abc import Sequence

TIME = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
_TIME = re.compile(rf"\[?\(?\s*({TIME})\s*\)?\]?")

#: Vocal noises that are no words: hesitation and listening sounds, in any spelling length.
NOISE = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|e+h+|a+h+|h+m+|m+h+m*|m{2,}|u+h+u+h+|h+u+h+|m+h+m+|a+h+e+m+|o+h+m+|h+e+r+m+)\Z")
NOISE_PAIR = re.compile(r"\b(?:m+-?h+m+|u+h*-h+u+h+|u+h+-u+h+|m+-m+|a+h+-h+a+h*)\b")
#: Sounds and recorder marks inside the speech: anything bracketed, starred or between notes.
ANNOTATION = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>|\*[^*.!?]+\*|♪[^♪.!?]*♪|♪|\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\b")
WORD = re.compile(r"[a-z0-9']+")
_QUOTES = str.maketrans({"’": "'", "‘": "'", "ʼ": "'", "＇": "'", "`": "'", "′": "'"})

ROLES = {"advisor": "advisor", "optimize_rep": "optimize_rep", "optimize rep": "optimize_rep", "optimize": "optimize_rep", "representative": "optimize_rep", "rep": "optimize_rep"}


def seconds(text: str | None) -> int | None:
    """Whole seconds of a time in any of the recorders' spellings; two parts are minutes and seconds."""
    if not text:
        return None
    m = _TIME.fullmatch(text.strip())
    if not m:
        return None
    total = 0
    for part in re.split(r"[.,]", m[1])[0].split(":"):
        total = total * 60 + int(part)
    return total


class _Noise(dict):
    """Whether a word is a vocal noise; words recur, so the answers are kept."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = NOISE.match(word) is not None
        return found


_noise = _Noise()
#: Without one of these there is no annotation.
_MARKED = re.compile(r"[\[({<*♪]|\d:\d")


def clean(text: str | None) -> str:
    """The spoken words only, joined by single spaces."""
    if not text:
        return ""
    if not text.isascii() or "`" in text:
        text = text.translate(_QUOTES)
    if _MARKED.search(text):
        text = ANNOTATION.sub(" ", text)
    text = text.lower()
    if "-" in text:
        text = NOISE_PAIR.sub(" ", text)
    return " ".join([w for w in WORD.findall(text) if not _noise[w]])


def _edits(a: str, b: str, most: int) -> int:
    """Damerau distance with adjacent swaps, up to most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return one[-1]


def plain_label(label: str) -> str:
    text = re.sub(r"\s+", " ", label.translate(_QUOTES)).strip().strip("[]<>").rstrip(":").strip().lower()
    return text


Person = tuple[int, str, str]


def speaker_of(label: str | None, people: Sequence[Person]) -> int:
    """The number of the participant a label means, 0 if it names none or more than one.

    people: (speaker_no, full name, role).  Exact forms come before abbreviated
    and misspelt ones; a form that fits two people equally names none.
    """
    if not label:
        return 0
    text = plain_label(label)
    people = sorted(people)
    m = re.fullmatch(r"speaker[ _#-]*0*(\d+)", text)
    if m:
        return int(m[1]) if any(p[0] == int(m[1]) for p in people) else 0
    m = re.fullmatch(r"(advisor|optimize[_ ]rep|optimize|representative|rep)(?:[ _#-]*0*(\d+))?", text)
    if m:
        same = [p[0] for p in people if p[2] == ROLES[m[1]]]
        if m[2]:
            return same[int(m[2]) - 1] if 1 <= int(m[2]) <= len(same) else 0
        return same[0] if len(same) == 1 else 0
    role = None
    m = re.fullmatch(r"(.*\S)\s*\((.*)\)", text)
    if m:
        text, role = m[1], ROLES.get(m[2].strip())
    text = re.sub(r"'s? (?:i?phone|ipad|cell|mobile|laptop|desk|line|office|pc|mac|macbook|computer|tablet|room)$", "", text)
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first.strip()} {last.strip()}"
    if not text:
        return 0

    def hits(test) -> list[int]:
        found = [p for p in people if p[1].split() and test(p[1].lower().split())]
        if len(found) > 1 and role:
            found = [p for p in found if p[2] == role] or found
        return [p[0] for p in found]

    parts = text.split()
    tests = [
        lambda n: n == parts,
        lambda n: len(parts) == 1 and parts[0] in (n[0], n[-1]),
        lambda n: len(parts) == 2 and parts[0] == n[0] and parts[1].rstrip(".") == n[-1][0],
        lambda n: len(parts) == 2 and parts[0].rstrip(".") == n[0][0] and parts[1] == n[-1],
        lambda n: text.replace(".", "").replace(" ", "") == "".join(x[0] for x in n),
    ]
    for t in tests:
        found = hits(t)
        if found:
            return found[0] if len(found) == 1 else 0
    if len(text) >= 4:
        most = 2 if len(text) >= 9 else 1
        scored = []
        for no, name, _ in people:
            n = name.lower().split()
            if not n:
                continue
            forms = [" ".join(n), n[0], n[-1], f"{n[0]} {n[-1][0]}.", f"{n[0][0]}. {n[-1]}"]
            scored.append((min(_edits(text, f, most) for f in forms if len(f) >= 4 or f == forms[0]), no))
        scored.sort()
        if scored and scored[0][0] <= most and (len(scored) == 1 or scored[1][0] > scored[0][0]):
            return scored[0][1]
    return 0
