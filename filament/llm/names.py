"""Reading of hand-typed and labelled person names."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

from filament.llm.bktree import BKTree, levenshtein

# Civilities, offices and filler of registration lists and transcripts (folded).
CIVILITIES = {"m": "M.", "mr": "M.", "monsieur": "M.", "mme": "Mme", "madame": "Mme", "mlle": "Mme", "mademoiselle": "Mme"}
OFFICES = {
    "president": "president", "presidente": "president", "rapporteur": "rapporteur", "rapporteure": "rapporteur", "rapporteuse": "rapporteur", "ministre": "ministre",
    "secretaire": "secretaire", "depute": "depute", "deputee": "depute", "senateur": "senateur", "senatrice": "senateur", "orateur": "orateur", "oratrice": "orateur",
    "commission": "commission", "gouvernement": "gouvernement", "questeur": "questeur", "doyen": "doyen", "doyenne": "doyen",
}
FILLER = {"orateur", "oratrice", "inscr", "inscrit", "inscrite", "dg", "abs", "absent", "absente", "remplace", "remplacee", "parole", "groupe", "min", "gr", "excuse", "excusee", "suppleant", "suppleante", "puis", "note"}

_MOJIBAKE = re.compile("[ÃÂâ][\u0080-ÿ‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸž€]")
_LOOKS = str.maketrans("0135", "oles")


def repair(text: str) -> str:
    """Undoes UTF-8 that was read as Latin-1 or Windows-1252."""
    for _ in range(2):
        if not _MOJIBAKE.search(text):
            break
        for code in ("latin-1", "cp1252"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            break
    return text


def fold(text: str) -> str:
    """Lower case without marks; ligatures spelled out."""
    text = text.lower().replace("œ", "oe").replace("æ", "ae").replace("’", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def squeeze(name: str) -> str:
    return re.sub(r"[^a-z]", "", name)


#: The most slips that ``reach`` allows.
MAX_SLIPS = 3
#: An entry of more tokens than this holds a note besides a name; names in it have up to WINDOW_TOKENS.
NAME_TOKENS, WINDOW_TOKENS = 12, 6


def reach(length: int) -> int:
    """Slips allowed in a name of so many letters."""
    return 0 if length <= 2 else 1 if length <= 5 else 2 if length <= 8 else 3


class Register:
    """The persons of a reference list, and what a typed name can mean among them."""

    def __init__(self, persons: list[tuple], groups: dict[str, str]):
        """``persons``: (uid, civ, prenom, nom, groupe_uid); ``groups``: folded code or name -> uid."""
        self.groups = groups
        self.codes = {g for g in groups if g.isalpha() and len(g) <= 4}
        self.persons = []
        self.by_name: dict[str, set[int]] = defaultdict(set)
        for uid, civ, prenom, nom, groupe in persons:
            if not uid or not nom:
                continue
            i = len(self.persons)
            first = fold(prenom or "")
            whole = squeeze(fold(nom))
            self.persons.append((uid, CIVILITIES.get(squeeze(fold(civ or ""))), first, groupe, whole))
            self.by_name[whole].add(i)
            if "-" in nom:
                self.by_name[squeeze(fold(nom.split("-")[0]))].add(i)
        self.tree = BKTree(sorted(n for n in self.by_name if n))
        self.longest = max((len(n) for n in self.by_name), default=0)
        self.longest_first = max((len(squeeze(p[2])) for p in self.persons), default=0)
        self.memo: dict[tuple[str, int], list[str]] = {}
        self.distances: dict[str, dict[int, int]] = {}

    def surnames(self, word: str, slips: int) -> list[str]:
        """The surnames just so many slips from a word, if their lengths allow these."""
        if slips > reach(len(word)):
            return []
        if (word, slips) not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            if len(self.distances) > 1_000:
                self.distances.clear()
            self.memo[word, slips] = [n for d, n in self.tree.within(word, slips, self.distances.setdefault(word, {})) if d == slips <= reach(len(n))]
        return self.memo[word, slips]

    def read(self, text: str | None) -> tuple[str | None, str | None, str | None, list[str]]:
        """(civility, office, group uid, name tokens) of a typed entry or label."""
        t = fold(repair(text or ""))
        t = re.sub(r"\s+", " ", t.replace("\x00", " ")).strip()
        group = None
        for m in re.finditer(r"\(([^)]*)\)", t):
            group = group or self.groups.get(m.group(1).strip())
        t = re.sub(r"\([^)]*\)?", " ", t)
        if m := re.search(r"[,\s-]*\b(?:groupe|gr\.?)\s+([a-z' -]+?)\W*$", t):
            if found := self.groups.get(m.group(1).strip()):
                group, t = group or found, t[: m.start()]
        if (m := re.search(r"[\s,-]+([a-z]{2,4})\W*$", t)) and m.group(1) in self.codes and t[: m.start()].strip():
            group, t = group or self.groups[m.group(1)], t[: m.start()]
        t = re.sub(r"^\W*[0-9]{1,3}\s*[.)/:-]+\s*", "", t)
        t = re.sub(r"\s[-–]\s", " , ", t)
        civ = office = None
        names: list[str] = []
        words = [w for w in re.split(r"[\s,;:/*?!\"«»_]+", t) if w.strip(".-'")]
        for k, w in enumerate(words):
            bare = w.strip(".-'")
            plain = re.sub(r"^[dl]'", "", bare)
            if bare in CIVILITIES and not names and (civ is None or len(bare) > 1) and k + 1 < len(words):
                civ = civ or CIVILITIES[bare]
            elif plain in OFFICES and not names:
                office = OFFICES[plain]
            elif plain == "etat" and office == "secretaire":
                continue
            elif bare in FILLER:
                continue
            elif w == bare and bare in ("le", "la", "a", "les", "un", "une", "au", "d", "l") and not names and k + 1 < len(words) and (bare in ("a", "au", "un", "une", "les") or re.sub(r"^[dl]'", "", words[k + 1].strip(".-'")) in OFFICES | dict.fromkeys(FILLER, "") | dict.fromkeys(CIVILITIES, "")):
                continue
            elif bare.isdigit():
                continue
            else:
                names.append(w.translate(_LOOKS) if re.search("[0-9]", w) else w)
        return civ, office, group, names

    def first_fits(self, typed: list[str], first: str) -> int | None:
        """Slips between a typed first name or initials and a person's first name; None: it does not fit."""
        whole = squeeze(first)
        got = squeeze("".join(typed))
        if not got:
            return 0
        if not whole:
            return None
        parts = [p for p in re.split(r"[^a-z]+", first) if p]
        initials = "".join(p[0] for p in parts)
        bits = [b for b in re.split(r"[^a-z]+", " ".join(typed)) if b]
        if all(len(b) == 1 for b in bits) or (len(bits) == 1 and got == initials and len(got) > 1):
            return 0 if initials.startswith(got) else None
        if len(got) <= 3 and whole.startswith(got):
            return 0
        d = levenshtein(got, whole)
        if d <= min(reach(len(whole)), max(1, len(whole) // 3)) or d <= reach(min(len(got), len(whole))):
            return d
        if len(parts) > 1 and levenshtein(got, parts[0]) <= min(1, len(parts[0]) // 4):
            return 1
        return None

    def meant(self, text: str | None) -> list[str]:
        """The uids a typed name may mean: those that fit with the fewest slips."""
        return self.scored(text)[1]

    def _whole(self, names: list[str]) -> Iterator[tuple[str, list[str]]]:
        """All readings of name tokens as (surname, tokens of the first name), of any length."""
        sizes = [len(squeeze(w)) for w in names]
        # Longer than any surname with any first name, all slips included: no person can fit.
        if sum(sizes) > self.longest + self.longest_first + 2 * MAX_SLIPS:
            return
        n = len(names)
        for k in range(n):
            for surname, first in ((names[k:], names[:k]), (names[: n - k], names[n - k :])) if k else ((names, []),):
                word = squeeze("".join(surname))
                if len(word) < 3 or any(len(w) <= 2 and w.endswith(".") for w in surname):
                    continue  # too short, or with an initial
                yield word, first

    def _windows(self, names: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The readings of every few tokens in a row that have a first name or an initial with a dot."""
        seen: set[tuple[str, ...]] = set()
        for i in range(len(names)):
            for j in range(i + 2, min(i + WINDOW_TOKENS, len(names)) + 1):
                if (window := tuple(names[i:j])) in seen:
                    continue
                seen.add(window)
                for word, first in self._whole(list(window)):
                    if first and any(len(squeeze(w)) > 1 or w.endswith(".") for w in first):
                        yield word, first

    def scored(self, text: str | None, notes: bool = False) -> tuple[int, list[str]]:
        """(slips, uids) of the persons a typed name fits best.

        One uid: it means that person. Several: it does not tell them apart. None: nobody listed.
        A first name or initial that is given must fit; civility and group tell persons apart, and
        one that contradicts a person rules that person out. A name may have any length. With ``notes``
        a text of more than ``NAME_TOKENS`` tokens is taken to hold a note as well: the name may then
        stand anywhere in it, but must have its first name or an initial with a dot beside it, since
        a word alone may be part of the note.
        """
        civ, _, group, names = self.read(text)
        names = [w for w in names if squeeze(w)]
        splits = list(self._whole(names))
        if notes and len(names) > NAME_TOKENS:
            splits += self._windows(names)
        best, found = 99, set()
        # Circles widen up to the full reach; those beyond the best total can neither beat nor equal it.
        for d in range(reach(max((len(w) for w, _ in splits), default=0)) + 1):
            if d > best:
                break
            for word, first in splits:
                for name in self.surnames(word, d):
                    for i in self.by_name[name]:
                        uid, p_civ, p_first, p_group, _ = self.persons[i]
                        if (civ and p_civ and civ != p_civ) or (group and p_group != group):
                            continue
                        slips = self.first_fits(first, p_first)
                        if slips is None:
                            continue
                        total = d + slips
                        if total < best:
                            best, found = total, {uid}
                        elif total == best:
                            found.add(uid)
        return best, sorted(found)


# What stands in a label for "unknown" (folded, without outer signs).
PLACEHOLDERS = {"", "null", "none", "nan", "nil", "na", "n/a", "inconnu", "inconnue", "unknown", "unk", "indetermine", "indeterminee", "non identifie", "non identifiee", "anonyme", "speaker", "locuteur"}
_NUMBERED = re.compile(r"(?:speaker|spkr|spk|sp|s|locuteur|locutrice|loc|orateur|intervenant|voix)[\s_.#°n-]*0*([0-9]{1,6})|0*([0-9]{1,6})")


def label_key(register: Register, label: str | None, strict: bool = False, uids: list[str] | None = None) -> str | None:
    """One key for all labels that name the same number, office or person; None: it names nobody.

    ``strict`` is for words that stand before a colon in a text: these are a label only if they are a
    number label, an office, a listed person, or a civility with a name. ``uids`` are the persons that
    the label may mean, where they have been looked up before.
    """
    text = fold(repair(label or "")).strip(" \t\r\n\xa0:.;,?!*<>-–—_\"'[]")
    if text in PLACEHOLDERS:
        return None
    if m := _NUMBERED.fullmatch(text):
        if strict and m.group(2):
            return None
        return f"#{m.group(1) or m.group(2)}"
    civ, office, _, names = register.read(label)
    if not names:
        if office and (not strict or len(text.split()) <= 5):
            return f"office:{office}"
        return None if strict else f"raw:{text}"
    uids = register.meant(label) if uids is None else uids
    if len(uids) == 1:
        return f"p:{uids[0]}"
    if uids:
        return "a:" + "|".join(uids)
    if strict and not (civ and len(names) <= 5 and len(text) <= 60):
        return None
    return "n:" + squeeze("".join(names)) if squeeze("".join(names)) else f"raw:{text}"


def register_of(acteurs_rows, organes_rows) -> Register:
    """A register from rows of acteurs (uid, civ, prenom, nom, groupe_uid) and organes (uid, libelle, libelle_abrege)."""
    groups = {}
    for uid, libelle, code in organes_rows:
        for g in (libelle, code):
            if g and uid:
                groups[re.sub(r"\s+", " ", fold(g)).strip()] = uid
    return Register(list(acteurs_rows), groups)
