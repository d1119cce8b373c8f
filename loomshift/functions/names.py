"""Identifiers as words, on the driver and as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an identifier parts, as a Java expression.
SPLIT = r"[^\p{L}\p{Nd}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: Prefixes that say nothing.
NOISE = ("tbl", "tb", "vw", "fld", "col")
#: Abbreviations and the words they stand for.
ABBREVIATIONS = {
    "acct": "account", "addr": "address", "amt": "amount", "at": "date", "avg": "average", "bal": "balance", "cat": "category", "ccy": "currency",
    "cd": "code", "clnt": "client", "cmnt": "comment", "cmt": "comment", "cnt": "count", "cntry": "country", "cre": "created", "crt": "created",
    "ctry": "country", "curr": "currency", "cust": "customer", "del": "deleted", "dept": "department", "desc": "description", "descr": "description",
    "dob": "birth date", "dst": "destination", "dt": "date", "emp": "employee", "eml": "email", "flg": "flag", "fname": "first name", "hdr": "header",
    "img": "image", "inv": "invoice", "lat": "latitude", "lname": "last name", "ln": "line", "lng": "longitude", "loc": "location", "lon": "longitude",
    "lvl": "level", "mgr": "manager", "mob": "mobile", "msg": "message", "mth": "month", "nbr": "number", "nm": "name", "no": "number", "num": "number",
    "on": "date", "ord": "order", "org": "organization", "pct": "percent", "ph": "phone", "postcode": "postal code", "prc": "price", "prod": "product",
    "pwd": "password", "qty": "quantity", "ref": "reference", "seq": "sequence", "src": "source", "stat": "status", "sts": "status", "tel": "phone",
    "tgt": "target", "tot": "total", "ts": "timestamp", "ttl": "total", "txt": "text", "typ": "type", "upd": "updated", "usr": "user", "yr": "year",
    "zip": "postal code",
}
#: Words of one meaning, the first standing for all.
GROUPS = (("customer", "client"), ("product", "item"), ("last", "surname"), ("first", "forename", "given"), ("phone", "telephone"), ("mobile", "cell"), ("email", "mail"), ("created", "inserted"), ("updated", "modified", "changed"), ("deleted", "removed"), ("active", "enabled"), ("time", "timestamp"), ("comment", "remark"), ("organization", "organisation"))


def _parted(name: str):
    """Letters, digits and the rest, and where case turns."""
    word = ""
    for k, c in enumerate(name):
        if not (c.isalpha() or c.isdecimal()):
            if word:
                yield word
            word = ""
            continue
        before, after = (word[-1:] or " "), name[k + 1 : k + 2]
        turns = word and (before.islower() and c.isupper() or before.isalpha() != c.isalpha() or before.isupper() and c.isupper() and after.islower())
        if turns:
            yield word
            word = ""
        word += c
    if word:
        yield word


def split_identifier(name: str) -> list[str]:
    return [w.lower() for w in _parted(name)]


def singular(word: str) -> str:
    if len(word) < 3 or word.endswith(("ss", "us", "is")):
        return word
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if re.search("(ss|us|x|ch|sh)es$", word):
        return word[:-2]
    return word[:-1] if word.endswith("s") else word


class Synonyms:
    """Abbreviations and groups; later additions win, and groups that overlap become one."""

    def __init__(self, more_abbreviations: dict[str, str] | None = None, more_groups: tuple[tuple[str, ...], ...] = ()):
        self.short = ABBREVIATIONS | (more_abbreviations or {})
        self.first: dict[str, str] = {}
        for group in (*GROUPS, *more_groups):
            head = next((self.first[w] for w in group if w in self.first), group[0])
            joined = {w for w, h in self.first.items() if h in {self.first.get(x) for x in group} - {None}}
            for w in (*group, *joined):
                self.first[w] = head

    def expand(self, word: str) -> list[str] | None:
        words = self.short.get(word, word if word in self.first else "").split()
        return [self.first.get(w, w) for w in words] or None


def name_tokens(name: str, synonyms: Synonyms | None = None, context: frozenset[str] = frozenset()) -> list[str]:
    """The words of a name: noise dropped, synonyms expanded, singular, distinct, those of the context dropped if others stay."""
    synonyms = synonyms or Synonyms()
    words = split_identifier(name)
    while len(words) > 1 and words[0] in NOISE:
        words = words[1:]
    out = [x for w in words for x in (synonyms.expand(w) or synonyms.expand(singular(w)) or [singular(w)])]
    out = list(dict.fromkeys(map(singular, out)))
    return [w for w in out if w not in context] or out


def identifier_words(name: Column) -> Column:
    return F.transform(F.filter(F.split(name, SPLIT), lambda w: w != ""), F.lower)
