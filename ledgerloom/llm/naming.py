"""How people write the names of firms and persons: folding, parts, abbreviations, and whether two spellings can mean one payee.

Nothing here knows particular suppliers.  Which words are common (trades, places, first names) is counted from the names
at hand and given to ``Vocabulary``; short forms and slips of common words are resolved against it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

# Legal forms by the way they are written, titles, nicknames and letters typed as figures.
LEGAL_FORMS = {
    "LTD": "LTD", "LIMITED": "LTD", "LIMTED": "LTD", "LIMIED": "LTD", "LIMITD": "LTD", "PLC": "PLC", "LLP": "LLP", "CIC": "CIC", "SARL": "SARL", "GMBH": "GMBH", "AB": "AB", "BV": "BV", "INC": "INC", "SA": "SA", "AG": "AG", "OY": "OY", "SRL": "SRL",
}
LONG_FORMS = (("PUBLIC LIMITED COMPANY", "PLC"), ("LIMITED LIABILITY PARTNERSHIP", "LLP"), ("COMMUNITY INTEREST COMPANY", "CIC"), ("COMMUNITY INTEREST CO", "CIC"))
CUT_FORMS = {"L", "LI", "LIM", "LIMI", "LIMIT", "LIMITE", "LT", "PL", "LL", "CI"}
TITLES = {"MR", "MRS", "MS", "MISS", "MX", "DR", "PROF", "SIR", "REV", "DAME"}
NICKNAMES = {
    "ANDY": "ANDREW", "DREW": "ANDREW", "TONY": "ANTHONY", "ANT": "ANTHONY", "BILL": "WILLIAM", "WILL": "WILLIAM", "BILLY": "WILLIAM", "WILLY": "WILLIAM", "LIAM": "WILLIAM", "BOB": "ROBERT", "ROB": "ROBERT", "BOBBY": "ROBERT", "ROBBIE": "ROBERT", "BERT": "ROBERT",
    "DICK": "RICHARD", "RICK": "RICHARD", "RICH": "RICHARD", "RICKY": "RICHARD", "JIM": "JAMES", "JIMMY": "JAMES", "JAMIE": "JAMES", "JACK": "JOHN", "JOHNNY": "JOHN", "JON": "JONATHAN", "MIKE": "MICHAEL", "MICK": "MICHAEL", "MICKEY": "MICHAEL", "CHRIS": "CHRISTOPHER", "KIT": "CHRISTOPHER",
    "DAVE": "DAVID", "DAVY": "DAVID", "STEVE": "STEPHEN", "STEVEN": "STEPHEN", "TOM": "THOMAS", "TOMMY": "THOMAS", "JOE": "JOSEPH", "JOEY": "JOSEPH", "CHARLIE": "CHARLES", "CHUCK": "CHARLES", "DAN": "DANIEL", "DANNY": "DANIEL", "MATT": "MATTHEW", "NICK": "NICHOLAS", "PETE": "PETER",
    "SAM": "SAMUEL", "BEN": "BENJAMIN", "ED": "EDWARD", "TED": "EDWARD", "EDDIE": "EDWARD", "NED": "EDWARD", "GREG": "GREGORY", "KEN": "KENNETH", "RON": "RONALD", "DON": "DONALD", "PHIL": "PHILIP", "TIM": "TIMOTHY", "PAT": "PATRICIA", "PATTY": "PATRICIA", "TRISH": "PATRICIA", "TRICIA": "PATRICIA",
    "LIZ": "ELIZABETH", "BETH": "ELIZABETH", "BETTY": "ELIZABETH", "ELIZA": "ELIZABETH", "LIZZIE": "ELIZABETH", "MAGGIE": "MARGARET", "MEG": "MARGARET", "PEGGY": "MARGARET", "MARGE": "MARGARET", "RITA": "MARGARET", "SUE": "SUSAN", "SUSIE": "SUSAN", "SUZY": "SUSAN", "KATE": "KATHERINE", "KATHY": "KATHERINE", "CATH": "CATHERINE", "CATHY": "CATHERINE", "KATIE": "KATHERINE",
    "JEN": "JENNIFER", "JENNY": "JENNIFER", "DEB": "DEBORAH", "DEBBIE": "DEBORAH", "DEBS": "DEBORAH", "ALEX": "ALEXANDRA", "SANDRA": "ALEXANDRA", "LEXI": "ALEXANDRA", "BECKY": "REBECCA", "VICKY": "VICTORIA", "TORI": "VICTORIA", "VIC": "VICTORIA", "CHRISSIE": "CHRISTINE", "TINA": "CHRISTINE", "BARB": "BARBARA", "BABS": "BARBARA", "MANDY": "AMANDA", "JO": "JOANNA", "SALLY": "SARAH", "SADIE": "SARAH", "NELL": "HELEN", "NELLIE": "HELEN", "FRANK": "FRANCIS", "FRANKIE": "FRANCIS", "FRAN": "FRANCIS", "HARRY": "HENRY", "HAL": "HENRY",
}
# Nicknames of more than one name.
SHARED_NICKNAMES = {"CHRIS": ("CHRISTOPHER", "CHRISTINE"), "CHRISSIE": ("CHRISTINE",), "PAT": ("PATRICIA", "PATRICK"), "ALEX": ("ALEXANDRA", "ALEXANDER"), "SANDY": ("ALEXANDRA", "ALEXANDER"), "SAM": ("SAMUEL", "SAMANTHA"), "FRAN": ("FRANCIS", "FRANCES"), "STEPH": ("STEPHANIE", "STEPHEN"), "NICKY": ("NICHOLAS", "NICOLA"), "TERRY": ("TERENCE", "TERESA"), "KIT": ("CHRISTOPHER", "KATHERINE"), "JO": ("JOANNA", "JOSEPH"), "KATE": ("KATHERINE", "CATHERINE"), "KATIE": ("KATHERINE", "CATHERINE"), "KATHY": ("KATHERINE", "CATHERINE"), "TONI": ("ANTONIA", "ANTHONY")}
_FIGURES = str.maketrans("013458", "OIEASB")

_TRADING = re.compile(r"\b(?:T\s*[/\\]\s*A|TRADING\s+AS)\b.*$", re.S)
_CODE = re.compile(r"\s*(?:\(\s*\d+\s*\)|[/#-]\s*\d{3,})\s*$")
_DOTTED = re.compile(r"\b((?:[A-Z]\.\s?){2,}(?:[A-Z]\b)?)")


def fold(text: str) -> str:
    """Capitals without marks, trading style and trailing account codes; legal forms in dots are closed up."""
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    t = "".join(c for c in t if not unicodedata.combining(c)).upper().replace("Ł", "L").replace("Ø", "O")
    t = _TRADING.sub("", t)
    t = _CODE.sub("", t)
    for dotted in _DOTTED.findall(t):
        closed = re.sub(r"[.\s]", "", dotted)
        if closed in LEGAL_FORMS:
            t = t.replace(dotted, f" {closed} ")
    return t


def words(text: str) -> list[str]:
    """Words of a folded text: letters and figures, '&' and '+' as AND, figures inside words read as letters."""
    t = re.sub(r"[&+]", " AND ", text)
    t = re.sub(r"['’`.]", "", re.sub(r"\.(?=\w)", " ", t))
    out = []
    for w in re.findall(r"[^\W_]+", t):
        out.append(w.translate(_FIGURES) if any(c.isdigit() for c in w) and sum(c.isalpha() for c in w) >= 2 else w)
    return out


def within_one(a: str, b: str) -> bool:
    """Whether two texts differ by at most one inserted, dropped, changed or (with its neighbour) swapped letter."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    if n == m:
        return x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])
    return x[1:] == y if n > m else y[1:] == x


def shorter_by_one(word: str) -> set[str]:
    """``word`` and what is left of it without one letter; words within one edit have one of these in common."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


@lru_cache(maxsize=1 << 15)
def letters(text: str) -> Counter[str]:
    """How often a text holds each letter."""
    return Counter(text)


def damerau(a: str, b: str, cap: int = 9) -> int:
    """Edit distance with swaps of neighbouring letters counted once (the unrestricted, metric form), or ``cap`` + 1 if it is more.

    Only places that differ by at most ``cap`` are looked at, so the cost grows with the length of the texts, not its square.
    """
    n, m, far = len(a), len(b), cap + 1
    if a == b:
        return 0
    if abs(n - m) > cap:
        return far
    # an edit takes away at most one letter that the other text lacks
    mine, other = letters(a), letters(b)
    if max((mine - other).total(), (other - mine).total()) > cap:
        return far
    width = 2 * cap + 1
    # row i holds the distances of a[:i] to b[:j] for j from i - cap to i + cap
    rows = [[min(far, max(j, 0)) if j >= 0 else far for j in range(-cap, cap + 1)]]
    at = lambda i, j: rows[i][j - i + cap] if 0 <= j - i + cap < width else far
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row = [far] * width
        rows.append(row)
        low = max(1, i - cap)
        if i <= cap:
            row[cap - i] = i
        # the last place of this letter in b before the places at hand, if near enough to matter
        last = b.rfind(x, max(0, low - 2 - cap), low - 1) + 1
        for j in range(low, min(m, i + cap) + 1):
            y = b[j - 1]
            best = min(at(i - 1, j - 1) + (x != y), at(i - 1, j) + 1, at(i, j - 1) + 1)
            k = seen.get(y, 0)
            if k and last:
                best = min(best, at(k - 1, last - 1) + i - k + j - last - 1)
            if x == y:
                last = j
            row[j - i + cap] = min(best, far)
        seen[x] = i
    return at(n, m)


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` is a usual short form of ``word``: its start, its consonants' start, or letters of it in order from first to last."""
    if len(short) < 3 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    bones = word[0] + re.sub(r"[AEIOU]", "", word[1:])
    if bones.startswith(short):
        return True
    it = iter(word)
    inside = all(c in it for c in short)
    return inside and (short[-1] == word[-1] or (word[-1] == "S" and short[-1] == word[-2]) or (short[-1] == "S" and shortens(short[:-1], word)))


@dataclass(frozen=True)
class Name:
    """A spelling's parts: words of its core in order, legal form ('' if none), whether the end may be cut off."""

    core: tuple[str, ...]
    form: str
    cut: bool

    @property
    def key(self) -> str:
        return " ".join(sorted(self.core)) + "|" + self.form


class Vocabulary:
    """Common words with their counts, and the resolution of short forms and slips to them."""

    def __init__(self, counts: dict[str, int], strong: int = 30, cut_at: int = 24) -> None:
        self.counts = counts
        self.cut_at = cut_at
        self.by_first: dict[str, list[str]] = {}
        for w, n in counts.items():
            if len(w) >= 4 and n >= strong and w not in GIVEN:
                self.by_first.setdefault(w[0], []).append(w)
        self.known: dict[str, str] = {}
        self.taken: dict[str, tuple[str, ...]] = {}
        self.near: dict[str, list[str]] = {}
        self.longer: dict[str, list[str]] = {}
        for w in counts:
            self.longer.setdefault(w[0], []).append(w)
            for v in shorter_by_one(w):
                self.near.setdefault(v, []).append(w)

    def resolve(self, word: str) -> str:
        """The very common word that ``word`` shortens or misspells; itself, if there is none or more than one fits as well."""
        if len(word) < 3 or word in GIVEN:
            return word
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = self._resolve(word)
        return self.known[word]

    def _resolve(self, word: str) -> str:
        # a common word is a short form only of a much commoner one
        pool = [w for w in self.by_first.get(word[0], []) if w != word and self.counts[w] >= 4 * self.counts.get(word, 0)]
        if len(word) <= 8:
            for kind in (lambda w: w.startswith(word), lambda w: shortens(word, w)):
                found = [w for w in pool if len(w) > len(word) and kind(w)]
                if found:
                    shared = lambda w: next((k for k, (x, y) in enumerate(zip(w, word, strict=False)) if x != y), len(word))
                    most = max(map(shared, found))
                    found = [w for w in found if shared(w) == most]
                    return found[0] if len(found) == 1 else word
        if len(word) >= 5 and word not in self.counts:
            found = [w for ws in self.by_first.values() for w in ws if len(w) >= 5 and abs(len(w) - len(word)) <= 1 and within_one(word, w)]
            if len(found) == 1:
                return found[0]
        return word

    def within_one(self, word: str) -> set[str]:
        """The common words within one edit of ``word``, itself among them if it is common."""
        return {w for v in shorter_by_one(word) for w in self.near.get(v, ()) if within_one(w, word)}

    def stands_for(self, word: str) -> tuple[str, ...]:
        """The common words that a word can be taken for: itself, those within one edit and those it shortens.

        A common word of over three letters is only itself; a word of under four letters also stands for itself if it isn't common.
        """
        if word not in self.taken:
            if len(self.taken) > 500_000:
                self.taken.clear()
            found = {word} if word in self.counts or len(word) < 4 else set()
            if word not in self.counts or len(word) < 4:
                least = 4 if len(word) >= 4 else 3
                found |= {w for w in self.within_one(word) if len(w) >= least and len(word) >= 3}
                if len(word) <= 9:
                    found |= {w for w in self.longer.get(word[0], ()) if shortens(word, w)}
                found |= {w for w in (word + "AND", "AND" + word, word.removesuffix("AND"), word.removeprefix("AND")) if w in self.counts}
            self.taken[word] = tuple(sorted(found))
        return self.taken[word]

    def parse(self, text: str, resolve: bool = True) -> Name:
        folded = fold(text)
        parts = words(folded)
        joined = " ".join(parts)
        form = ""
        for long, short in LONG_FORMS:
            if long in joined:
                joined, form = joined.replace(long, " "), short
        parts = joined.split()
        while len(parts) > 2 and parts[-1].isdigit() and len(parts[-1]) >= 4:
            parts.pop()
        kept = []
        for k, w in enumerate(parts):
            if (k == 0 and w == "THE") or w == "AND" or (w in TITLES and len(parts) > 2):
                continue
            if 0 < k < len(parts) - 1 and (3 if len(parts) < 4 or parts[0] in TITLES else 2) <= len(w) <= 4 and w not in self.counts and within_one(w, "AND"):
                continue
            if w in LEGAL_FORMS and k:
                form = form or LEGAL_FORMS[w]
            elif k and k == len(parts) - 1 and len(w) >= 5 and within_one(w, "LIMITED"):
                form = form or "LTD"
            elif w in LEGAL_FORMS:
                form = form or LEGAL_FORMS[w]
            elif k > 1 and k == len(parts) - 1 and w in CUT_FORMS and (len(w) > 1 or not any(x in GIVEN or len(x) == 1 for x in kept)):
                continue
            else:
                kept.append(w)
        cut = len(text.rstrip()) in (self.cut_at - 1, self.cut_at) and not form
        if resolve:
            full = []
            for w in kept:
                whole = self.resolve(w)
                if whole == w and len(w) >= 9 and w not in self.counts:
                    whole = next((f"{w[: -len(c)]} {c}" for n in range(len(w) - 4, 4, -1) if (c := w[-n:]) in self.counts and c not in GIVEN), w)
                full.extend(whole.split())
            kept = full
        return Name(tuple(kept), form, cut)


def is_person(name: Name, common: dict[str, int]) -> bool:
    """Whether a parsed name reads as a person: no legal form, one or two given names or initials, one surname."""
    if name.form or not 2 <= len(name.core) <= 4:
        return False
    return sum(w in GIVEN or len(w) <= 2 for w in name.core) >= 1 and sum(w not in GIVEN and len(w) > 2 for w in name.core) == 1


def composite_keys(name: Name, vocabulary: Vocabulary) -> tuple[list[str], list[str]]:
    """Keys of a spelling that its distinctive words don't bring together with another: (keys, keys that only cut spellings meet).

    Every two words as the common words that they stand for; a person's surname with the initials; a cut spelling's whole
    words with the beginning of its last.  A spelling whose distinctive words are neither common words' slips nor short forms
    needs none, as another spelling of the payee has one of them too.
    """
    core = name.core
    taken = [vocabulary.stands_for(w) for w in core]
    own = [t for w, t in zip(core, taken, strict=True) if len(w) >= 4 and w not in vocabulary.counts]
    keys, begun = set(), set()
    if not own or name.cut or any(own):
        keys |= {"&".join(sorted((x, y))) for j in range(len(core)) for i in range(j) for x in taken[i] for y in taken[j]}
    if name.cut:
        keys |= {f"{x}&&{core[-1][:4]}" for t in taken[:-1] for x in t}
    if not own:
        begun = {f"{x}&&{v[:n]}" for i, t in enumerate(taken) for x in t for j, v in enumerate(core) if i != j for n in range(1, min(4, len(v)) + 1)}
    if is_person(name, vocabulary.counts):
        surname = next(w for w in core if w not in GIVEN and len(w) > 2)
        given = [w for w in core if w in GIVEN or len(w) <= 2]
        firsts = {f[0] for w in given for f in (w, *(SHARED_NICKNAMES.get(w) or (NICKNAMES.get(w, w),)))}
        keys |= {f"{s}&&&{f}" for s in vocabulary.within_one(surname) | (shorter_by_one(surname) if len(surname) <= 4 else set()) for f in firsts}
    return sorted(keys), sorted(begun - keys)


# Given names, formal ones and the nicknames above.
GIVEN = set(NICKNAMES) | set(NICKNAMES.values()) | set(SHARED_NICKNAMES) | {n for names in SHARED_NICKNAMES.values() for n in names} | set(
    "ALAN ALICE AMY ANNA ANNE ANGELA BARRY BRIAN CAROL CAROLINE CLAIRE COLIN DAVID DEREK DIANE DOROTHY EILEEN EMMA ERIC EVE FIONA FRANCES GARY GEORGE GERALD GORDON GRACE GRAHAM HAROLD HELEN HENRY HUGH IAN JANE JANET JEAN JOAN JOHN JOYCE JUDITH JULIE KAREN KEITH KEVIN LAURA LINDA LOUISE MALCOLM MARIA MARK MARTIN MARY MAUREEN NEIL NIGEL NORMAN OLIVER PAMELA PAUL PAULINE PETER RACHEL RAYMOND ROGER ROSE RUTH SARAH SHARON SHEILA SIMON STUART SUSAN TERESA TERENCE VALERIE WENDY".split()
)


def vague(name: Name) -> bool:
    """Whether a spelling may stand for several payees by itself: its end is cut off, or it gives a person's initials only."""
    return name.cut or not any(w in GIVEN for w in name.core) and any(len(w) <= 2 for w in name.core)


def given_matches(a: list[str], b: list[str]) -> tuple[bool, bool]:
    """(compatible, sure) for the given names and initials of two spellings of a person."""
    formal = lambda w: SHARED_NICKNAMES.get(w) or (NICKNAMES.get(w, w),)
    full = lambda ws: {n for w in ws if w in GIVEN for n in formal(w)}
    letters = lambda ws: "".join(w if w not in GIVEN and len(w) <= 2 else w[0] for w in ws)
    fa, fb = full(a), full(b)
    if fa and fb:
        return (bool(fa & fb), True)
    firsts = lambda ws: {w[0] for w in ws} | {n[0] for w in ws for n in formal(w)}
    if fa or fb:
        short, long = (b, a) if fa else (a, b)
        return (letters(short)[:1] in firsts([w for w in long if w in GIVEN]), False)
    x, y = letters(a), letters(b)
    return (x[:1] == y[:1] and (len(x) < 2 or len(y) < 2 or x == y), len(x) > 1 and x == y)


def same_payee(a: Name, b: Name, common: dict[str, int]) -> int:
    """2 if two spellings can only mean one payee, 1 if they may (initials, cut ends), 3 if one leaves out words, 0 if they can't."""
    if a.form and b.form and a.form != b.form:
        return 0
    pa, pb = is_person(a, common), is_person(b, common)
    if pa and pb:
        split = lambda n: ([w for w in n.core if w in GIVEN or len(w) <= 2], [w for w in n.core if w not in GIVEN and len(w) > 2])
        (ga, sa), (gb, sb) = split(a), split(b)
        if not within_one(sa[0], sb[0]):
            return 0
        fits, sure = given_matches(ga, gb)
        return (2 if sure else 1) if fits else 0
    left, right = list(a.core), list(b.core)
    for w in a.core:
        if w in right:
            left.remove(w)
            right.remove(w)
    shared = len(a.core) - len(left)
    if not left and not right:
        return 2
    edits = 0
    if left and right and _run_together(left, right):
        left, right, edits = [], [], 1
    for w in list(left):
        best = None
        for v in right:
            cost = _slip(w, v, common)
            if cost and (best is None or cost < best[0]):
                best = (cost, v)
        if best:
            edits += best[0]
            left.remove(w)
            right.remove(best[1])
    size = sum(map(len, a.core))
    if edits <= (1 if size < 9 else 2 if size < 16 else 3):
        if not left and not right:
            return 2
        if left and right and _run_together(left, right):
            return 2
        # one spelling leaves out a word or two, such as a place, but neither its own word nor its trade
        missing = left or right
        if not (left and right) and shared >= 2 and len(missing) <= 2 and not any(w in GIVEN or len(w) < 3 for w in missing):
            kept = [w for w in (b.core if right else a.core) if w not in missing]
            if any(w not in common for w in kept) and any(w in common for w in kept):
                return 3
    if a.cut or b.cut:
        for short, long in ((a, b), (b, a)):
            one, other = "".join(short.core), "".join(long.core)
            if short.cut and len(one) >= 8 and (other.startswith(one[:-1]) or (len(one) >= 10 and damerau(one, other[: len(one)], 2) <= 1)):
                return 1
            if short.cut and len(short.core) > 1 and _cut_words(short.core, long.core):
                return 1
    return 0


def _run_together(left: list[str], right: list[str]) -> bool:
    """Whether words written as one are the same but for one slip, an AND caught up in them aside."""
    a, b = "".join(left), "".join(right)
    return within_one(a, b) or (("AND" in a) != ("AND" in b) and min(len(a), len(b)) >= 5 and within_one(a.replace("AND", "", 1), b.replace("AND", "", 1)))


def _cut_words(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    """Whether the words of a cut spelling, the last by its start, are words of the other in any order."""
    rest = list(long)
    for w in short[:-1]:
        found = next((v for v in rest if v == w or (len(w) > 4 and within_one(v, w))), None)
        if found is None:
            return False
        rest.remove(found)
    return any(v.startswith(short[-1]) for v in rest)


def _slip(w: str, v: str, common: dict[str, int]) -> int:
    """The cost of taking one word for the other, 0 if they can't be the same."""
    if w in common and v in common and len(w) > 3 and len(v) > 3:
        return 0
    least, most = min(len(w), len(v)), max(len(w), len(v))
    if least >= 4 and within_one(w, v):
        return 1
    if least >= 8 and damerau(w, v, 2) <= 2:
        return 2
    if least <= 9 and ((v in common and shortens(w, v)) or (w in common and shortens(v, w))):
        return 1
    if w in (v + "AND", "AND" + v) or v in (w + "AND", "AND" + w):
        return 1
    return 2 if least >= 3 and most <= 4 and within_one(w, v) else 0
