"""Personal data in plain and disguised form, as spans of the source text.

Base spans are plain patterns on the text itself. For the rest a transducer
rewrites the text: homoglyphs and wide forms become ASCII, invisible characters
go, spelled digits become digits, and disguises of ``@`` and ``.`` are undone.
Every character that it emits remembers the source characters it stands for, so a
span found in the rewritten text is a span of the source.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins: the rest of a run fails where the run does.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    """Leftmost matches of the email pattern, found from each ``@`` outward, so
    a long run of letters isn't scanned again from each of its characters."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def plain(text: str) -> dict[str, list[Span]]:
    digits = DIGIT.search(text) is not None
    return {k: f(text) if digits or k == "email" else [] for k, f in FINDERS.items()}


# Letters of other scripts that look like an ASCII character, as code points.
HOMOGLYPHS = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i", "\u0458": "j", "\u0455": "s", "\u04bb": "h", "\u0501": "d", "\u051b": "q", "\u051d": "w",
    "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K", "\u041c": "M", "\u041d": "H", "\u041e": "O", "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0425": "X", "\u0406": "I", "\u0405": "S",
    "\u03bf": "o", "\u03bd": "v", "\u03b1": "a", "\u03b9": "i", "\u03ba": "k", "\u03c1": "p", "\u03c4": "t", "\u03c5": "u", "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u039f": "O", "\u03a1": "P", "\u03a4": "T",
    "\u0131": "i", "\u0261": "g", "\u2113": "l", "\u2024": ".", "\u3002": ".", "\ufe52": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
# Characters that don't show.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits of the corpus languages, without words that are common otherwise.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Names of characters in markup.
ENTITIES = {"commat": "@", "period": ".", "nbsp": " ", "plus": "+", "hyphen": "-", "lowbar": "_", "lpar": "(", "rpar": ")"}
# Letters written for digits.
LETTERS = str.maketrans("lIOo", "1100")


def _forms() -> dict[str, str]:
    """Every character that stands for an ASCII one: those above, digits of all
    scripts, and compatibility forms (wide, mathematical, circled, raised)."""
    out = dict.fromkeys(INVISIBLE, "")
    for i in range(0x80, 0x1FC00):
        c = chr(i)
        digit = unicodedata.digit(c, None)
        if new := HOMOGLYPHS.get(c) or (str(digit) if digit is not None else unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith(("<wide>", "<font>")) else ""):
            if len(new) == 1 and new.isascii():
                out[c] = new
    return out


FORMS = _forms()
ODD = re.compile(r"[^\x00-\x7F]")
ENTITY = re.compile(rf"&(?:#([0-9]{{1,6}})|#[xX]([0-9A-Fa-f]{{1,5}})|({'|'.join(ENTITIES)}));")
WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: At least three digits, one of them spelled, are a number; a spelled digit in prose is not.
NUMBER = re.compile(rf"(?<!\w)(?:{WORD}|plus|dot|point|[0-9])(?:(?:[ ,-]+|[ ]?[().][ ]?)(?:{WORD}|dot|point|[0-9])(?!\w)){{2,}}", re.I)
NUMBER_WORD = re.compile(rf"{WORD}|plus|dot|point", re.I)
NUMBER_HINT = re.compile(rf"(?<!\w){WORD}[ ,-]+(?:{WORD}|dot|point|[0-9])(?!\w)", re.I)
#: Characters of a number with letters among its digits, and groups of a card cut by other signs.
MIXED = re.compile(r"(?<![A-Za-z0-9])[+]?[(]?[0-9lIOo]++(?![A-Za-z])(?:[ ().-]++[0-9lIOo]++(?![A-Za-z]))*+")
MIXED_HINT = re.compile(r"[0-9][lIOo]|[lIOo][0-9]")
GROUPS = re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9]|\.[0-9])")
#: An address is found from its ``at``: a sign in brackets, dashes or underscores, a lone sign, or the bare word.
OPEN, CLOSE = r"[(\[{<]", r"[)\]}>]"
AT = re.compile(rf"[ ]*+{OPEN}[ ]*+(?:at|@|arroba|chez)[ ]*+{CLOSE}[ ]*+|[ ]*+(?P<cut>[-_]++)(?:at|arroba)[-_]++[ ]*+|(?P<sign>[ ]*+@[ ]*+)|(?P<word>[ ]++(?:at|arroba)[ ]++)", re.I)
SPOKEN_DOT = rf"[ ]*+{OPEN}[ ]*+(?:dot|\.|punto|point|punkt)[ ]*+{CLOSE}[ ]*+|[ ]*+[-_]++(?:dot|punto|punkt)[-_]++[ ]*+|[ ]++(?:dot|punto|punkt)[ ]++"
DOT = rf"(?:{SPOKEN_DOT}|[ ]++\.[ ]++)"
LABEL = r"(?:[A-Za-z0-9]|-(?!-*(?:dot|punto|punkt)[-_]))++"
HOST = re.compile(rf"{LABEL}(?:(?:{DOT}|\.){LABEL})++", re.I)
DOT_PART = re.compile(DOT, re.I)
#: The part before an ``at``, read backward: names and dots in turn.
NAME_BACK = re.compile(rf"(?:[A-Za-z0-9.%+_-](?<![-_](?=[-_](?:dot|tod)))|[ ]++(?:tod|otnup|tknup)[ ]++(?=[A-Za-z0-9])|[ ]*+[)\]}}>][ ]*+(?:tod|\.|otnup|tniop|tknup)[ ]*+[(\[{{<][ ]*+(?=[A-Za-z0-9]))++", re.I)
# Top-level domains of more than two letters; any two letters are a country's.
TOP = frozenset(
    "com org net edu gov mil int info biz name pro aero coop museum arpa asia cat jobs mobi tel travel post xxx app dev page blog shop store online site web website "
    "tech cloud digital email live news media agency studio design art music wiki world life today space club group team company business finance bank money "
    "health care clinic school academy university science research law legal live chat social network systems software solutions services support tools "
    "berlin hamburg koeln bayern wien paris london madrid barcelona eus gal bzh test example invalid local onion".split()
)
# countries' domains that follow "at the dot" in English prose.
PROSE = frozenset("an as am at be by do go he if in is it me my no of on or so to up us we".split())
#: What comes before an address in prose: with it, ``name at host.tld`` is one though nothing in it is disguised.
CUE = re.compile(r"(?:e-?mail|mail|contact|reach|write|address|correo|courriel|kontakt|adresse|contacto)\w*[^.!?\n]{0,30}$", re.I)
HOST_DOTS = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{SPOKEN_DOT}|\.)[0-9]++){{3}}(?![0-9])", re.I)
HINT = re.compile(rf"@|{OPEN}[ ]*+(?:at|arroba|chez)[ ]*+{CLOSE}|[-_](?:at|arroba)[-_]|[ ](?:at|arroba)[ ]", re.I)
DOT_HINT = re.compile(rf"[0-9](?:{SPOKEN_DOT})[0-9]", re.I)


class Tape:
    """Text with, for each character, the span of the source it stands for."""

    def __init__(self, text: str, spans: list[Span] | None = None):
        self.text, self.spans = text, spans

    def source(self, start: int, end: int) -> Span:
        return (start, end) if self.spans is None else (self.spans[start][0], self.spans[end - 1][1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replaces disjoint, ordered ranges; what comes in stands for all that went out."""
        if not edits:
            return self
        text, spans, at = [], [], 0
        old = self.spans if self.spans is not None else [(i, i + 1) for i in range(len(self.text))]
        for a, b, new in edits:
            text += [self.text[at:a], new]
            spans += old[at:a]
            spans += [(old[a][0], old[b - 1][1])] * len(new)
            at = b
        return Tape("".join([*text, self.text[at:]]), spans + old[at:])


def ascii_forms(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    return tape.rewrite([(m.start(), m.end(), FORMS[m[0]]) for m in ODD.finditer(tape.text) if m[0] in FORMS])


def entities(tape: Tape) -> Tape:
    edits = []
    if "&" in tape.text:
        for m in ENTITY.finditer(tape.text):
            code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else 0
            new = ENTITIES[m[3]] if m[3] else chr(code) if 32 <= code < 127 else FORMS.get(chr(code)) if code < 0x110000 else None
            if new is not None:
                edits.append((m.start(), m.end(), new))
    return tape.rewrite(edits)


def spelled_digits(tape: Tape) -> Tape:
    edits = []
    if NUMBER_HINT.search(tape.text):
        for m in NUMBER.finditer(tape.text):
            if not NUMBER_WORD.search(m[0]):
                continue
            new = NUMBER_WORD.sub(lambda w: SPELLED.get(w[0].lower()) or {"plus": "+"}.get(w[0].lower(), "."), m[0])
            edits.append((m.start(), m.end(), re.sub(r"[ ,]+", "", new)))
    return tape.rewrite(edits)


def mixed_digits(tape: Tape) -> Tape:
    """Letters for digits in what has seven digits at least and more digits than
    letters; other signs between the groups of a card as blanks."""
    edits = []
    for m in MIXED.finditer(tape.text) if MIXED_HINT.search(tape.text) else ():
        if len(m[0]) >= 8 and not m[0].isdigit():
            letters, digits = sum(map(str.isalpha, m[0])), sum(map(str.isdigit, m[0]))
            if letters and digits >= 7 and digits > letters:
                edits.append((m.start(), m.end(), m[0].translate(LETTERS)))
    tape = tape.rewrite([(a + i, a + i + 1, c) for a, b, new in edits for i, c in enumerate(new) if c != tape.text[a + i]])
    return tape.rewrite([(m.start() + i, m.start() + i + 1, " ") for m in GROUPS.finditer(tape.text) for i in (4, 9, 14)])


def _known(host: str, prose: bool) -> bool:
    top = host.rpartition(".")[2].lower()
    return top in TOP or len(top) == 2 and top.isalpha() and not (prose and top in PROSE)


def disguised(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn disguised addresses plain. From each ``at`` the host is read
    forward, then the name backward as far as the last address: every character is
    read a bounded number of times."""
    edits: list[tuple[int, int, str]] = []
    last, at = 0, AT.search(text)
    while at:
        following = at.end()
        host = HOST.match(text, at.end())
        found = host and _address(text, at, host, last)
        if found:
            edits.append(found)
            last = following = found[1]
        at = AT.search(text, following)
        # a host or name can't hold an at: what comes before it is read once
        last = max(last, following if not found else last)
    return edits


def _address(text: str, at: re.Match, host: re.Match, last: int) -> tuple[int, int, str] | None:
    plain_host = DOT_PART.sub(".", host[0])
    spoken = plain_host != host[0]
    if at["sign"] == "@" and not spoken:
        name = NAME_BACK.match(text[last : at.start()][::-1])
        if not name or not DOT_PART.search(name[0][::-1]):
            return None  # plain already
    # a stop with blanks around it is one of prose, a word at is, and so are dashes: these need a domain that exists
    careful = at["word"] or at["cut"] or " . " in host[0] or at["sign"] is not None and spoken
    prose = at["word"] is not None and spoken
    if careful and not _known(plain_host, prose):
        # the sentence may go on after the domain
        cut = re.match(rf"{LABEL}(?:(?:{DOT}|\.){LABEL})", host[0], re.I)
        plain_host = DOT_PART.sub(".", cut[0]) if cut else ""
        if not cut or not _known(plain_host, prose):
            return None
        host = HOST.match(text[: host.start() + cut.end()], host.start()) or host
    name = NAME_BACK.match(text[last : at.start()][::-1])
    if not name:
        return None
    start = at.start() - len(name[0])
    own = DOT_PART.sub(".", text[start : at.start()])
    if at["word"] and not spoken and not re.search(r"[0-9._%+-]", own.strip(".")):
        before = text[max(0, start - 40) : start]
        if before.rstrip(" \t\"'(:<").rpartition("\n")[2] and not before.endswith((":", ": ", "(", "<", '"')) and not CUE.search(before):
            return None
    return start, host.end(), f"{own}@{plain_host}"


def signs(tape: Tape) -> Tape:
    edits = disguised(tape.text) if HINT.search(tape.text) else []
    if DOT_HINT.search(tape.text):
        starts = [a for a, _, _ in edits]
        more = []
        for m in HOST_DOTS.finditer(tape.text):
            i = bisect.bisect_left(starts, m.end())
            if DOT_PART.search(m[0]) and not (i and edits[i - 1][1] > m.start()):
                more.append((m.start(), m.end(), DOT_PART.sub(".", m[0])))
        edits = sorted(edits + more)
    return tape.rewrite(edits)


def spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, spans that only the rewritten text shows), by kind. A found
    span that lies within a base span of its kind adds nothing."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base = plain(text)
    tape = signs(mixed_digits(spelled_digits(ascii_forms(entities(Tape(text))))))
    more: dict[str, list[Span]] = {k: [] for k in KINDS}
    if tape.spans is not None:
        for kind, found in plain(tape.text).items():
            own = base[kind]
            starts = [a for a, _ in own]
            for a, b in (tape.source(*s) for s in found):
                i = bisect.bisect_right(starts, a)
                if not i or own[i - 1][1] < b:
                    more[kind].append((a, b))
    return base, more


def listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found[k]))


def report(text: str | None) -> tuple:
    base, more = spans(text)
    both = {k: base[k] + more[k] for k in KINDS}
    return (*[len(base[k]) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), sum(map(len, more.values())), sum(map(len, both.values())))


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_spans long"


def reports(text: Column) -> Column:
    """Struct of the columns in SCHEMA."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([report(t) for t in batch], columns=names)

    return run(text)


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, base_sha256,
    spans (all, ``kind:start:end`` in code points, by kind and start) and
    n_disguised, how many of them only the rewritten text shows, and n_spans, how many there are.

    Null and empty texts have no spans. Whole texts are searched, in time linear
    in their length. Rows are independent of each other, so repeated rows and null ids need no
    care; only the two named columns are read."""
    return docs.select(F.col(doc_id).alias("doc_id"), reports(F.col(text)).alias("r")).select("doc_id", "r.*")


def masked(text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return t
            base, more = spans(t)
            found, out, at = sorted((a, b, k) for k in KINDS for a, b in base[k] + more[k]), [], 0
            for a, b, k in found:
                if a >= at:
                    out += [t[at:a], f"<{k}>"]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return batch.map(one)

    return run(text)
