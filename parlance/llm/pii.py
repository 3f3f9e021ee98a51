"""Personal information inside free text: find it at its place in the source and put typed placeholders there (problem 4).

A text passes transducers that keep offsets: look-alike letters and full-width forms become plain ones, spelled digits become
digits, and at/dot disguises become @ and dots. Detectors run on the normalised text; every found span is mapped back to the
characters of the source it came from, so the value is given exactly as it stands.

Kinds: email, phone, idnum (national identity, tax, passport or payment-card number; cards by check digit), address (street and
house number up to town or postcode) and name (given and family name in either order, with initials, without title).

Defined results: null, empty and blank texts hold nothing and stay as they are; repeated items of one text count once in `items`
and are all replaced in `redact`; overlapping finds are settled in the order of KINDS, then by place; whole texts are read;
empty tables give empty tables; extra columns are ignored (find) or kept (redact).
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "idnum", "phone", "address", "name")

# Transducers ------------------------------------------------------------------------------------------------------------------
# Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(
    zip("АВЕЅІЈКМНОРСТХУаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοι", "ABESIJKMHOPCTXYaeopcyxijshdqwABEZHIKMNOPTYXaoi", strict=True)
)
# Spelled digits of the languages in the data.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "零": "0", "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9",
}

_DIGIT_WORD = "|".join(sorted((w for w in SPELLED if w.isascii() or len(w) > 1), key=len, reverse=True))
#: Seven spelled digits or more in a row are a number.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{_DIGIT_WORD})[ \-,.]{{1,2}}){{6,}}(?:{_DIGIT_WORD})(?!\w)|[零一二三四五六七八九]{{7,}}", re.I)
_ONE_SPELLED = re.compile(rf"{_DIGIT_WORD}|[零一二三四五六七八九]", re.I)

_AT_MARK = r"\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?"
_DOT_MARK = r"\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9+_])?"
#: A disguised address: the at is marked, or it is a bare word and a dot of the domain is disguised too.
_DISGUISED = re.compile(
    rf"(?<![\w.%+\-])({_LOCAL}(?:(?:{_DOT_MARK}| dot ){_LOCAL})*)(?:({_AT_MARK})({_LABEL}(?:(?:\.|{_DOT_MARK}| dot ){_LABEL})+)|( at |@)({_LABEL}(?:\.{_LABEL})*(?:(?:{_DOT_MARK}| dot ){_LABEL}(?:\.{_LABEL})*)+))",
    re.I,
)
_MARKS = re.compile(r" dot |[(\[{<]\s?(?:dot|at|\.|@)\s?[)\]}>]", re.I)
_ANY_DOT = re.compile(rf"{_DOT_MARK}| dot ", re.I)


class Aligned:
    """A normalised text and, for runs of it, the place in the source."""

    __slots__ = ("at", "ends", "starts", "text")

    def __init__(self, text: str) -> None:
        self.text = text
        # Normalised position where a piece begins, and the piece's span in the source.
        self.at: list[int] = [0]
        self.starts: list[int] = [0]
        self.ends: list[int] = [len(text)]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the normalised text."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        return self._place(i, start, False), self._place(j, end, True)

    def _place(self, i: int, pos: int, end: bool) -> int:
        size = (self.at[i + 1] if i + 1 < len(self.at) else len(self.text)) - self.at[i]
        # Pieces of equal length map one to one; rewritten ones as a whole.
        if size == self.ends[i] - self.starts[i]:
            return self.starts[i] + pos - self.at[i]
        return self.ends[i] if end else self.starts[i]

    def rewrite(self, changes: Iterable[tuple[int, int, str]]) -> Aligned:
        """The text with spans of it replaced, in order and apart from each other."""
        out, pieces, place = [], [], 0
        length = 0

        def add(start: int, end: int, text: str) -> None:
            nonlocal length
            if text:
                out.append(text)
                pieces.append((length, *((self.span(start, end)) if end > start else (0, 0))))
                length += len(text)

        for start, end, text in changes:
            for s, e in self._runs(place, start):
                add(s, e, self.text[s:e])
            add(start, end, text)
            place = end
        for s, e in self._runs(place, len(self.text)):
            add(s, e, self.text[s:e])
        new = Aligned("".join(out))
        if pieces:
            new.at, new.starts, new.ends = (list(x) for x in zip(*pieces, strict=True))
        return new

    def _runs(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """The pieces of a span."""
        while start < end:
            i = bisect.bisect_right(self.at, start) - 1
            stop = min(end, self.at[i + 1] if i + 1 < len(self.at) else end)
            yield start, stop
            start = stop


def plain_letters(a: Aligned) -> Aligned:
    """Look-alike letters inside Latin words, full-width forms and odd spaces and dashes as plain ones."""
    if a.text.isascii():
        return a
    changes = []
    for i, ch in enumerate(a.text):
        if ch < "\x80":
            continue
        new = ch
        if ch in LOOKALIKE and any(x.isascii() and x.isalnum() for x in a.text[max(0, i - 1) : i] + a.text[i + 1 : i + 2]):
            new = LOOKALIKE[ch]
        elif "！" <= ch <= "～" or ch == "　":
            new = unicodedata.normalize("NFKC", ch)
        elif ch in "  ":
            new = " "
        elif ch in "‐‑‒–−":
            new = "-"
        elif ch in "​‌‍⁠":
            new = ""
        if new != ch:
            changes.append((i, i + 1, new))
    return a.rewrite(changes) if changes else a


def plain_digits(a: Aligned) -> Aligned:
    """Runs of seven spelled digits or more as digits."""
    low = a.text.lower()
    if sum(map(low.count, SPELLED)) < 7:
        return a
    changes = []
    for run in _SPELLED_RUN.finditer(a.text):
        end = run.start()
        for m in _ONE_SPELLED.finditer(a.text, run.start(), run.end()):
            if m.start() > end:
                changes.append((end, m.start(), ""))
            changes.append((m.start(), m.end(), SPELLED[m[0].lower()]))
            end = m.end()
    return a.rewrite(changes) if changes else a


def plain_marks(a: Aligned) -> Aligned:
    """At and dot disguises as @ and dots."""
    # A bare at needs a disguised dot, so texts with neither a dot word nor a marked at or dot have nothing to rewrite.
    if not _MARKS.search(a.text):
        return a
    changes = []
    for m in _DISGUISED.finditer(a.text):
        at, domain = (2, 3) if m[2] is not None else (4, 5)
        changes += [(*d.span(), ".") for d in _ANY_DOT.finditer(a.text, *m.span(1))]
        if m[at] != "@":
            changes.append((*m.span(at), "@"))
        changes += [(*d.span(), ".") for d in _ANY_DOT.finditer(a.text, *m.span(domain))]
    return a.rewrite(changes) if changes else a


def normalise(text: str) -> Aligned:
    return plain_marks(plain_digits(plain_letters(Aligned(text))))


# Detectors --------------------------------------------------------------------------------------------------------------------
_EMAIL = re.compile(rf"(?<![\w.%+\-/@])({_LOCAL})@({_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}})(?![\w@]|-\w)")
# Domains of placeholders.
PLACEHOLDER_DOMAINS = ("example.com", "example.org")

#: Words for numbers of other kinds, right before the number on its line; with an article before it the word is no label.
_REJECT_BEFORE = re.compile(
    r"(?<!\bthe )(?:\b(?:build|version|release|rev|revision|order|invoice no\.?|job id|job|part no\.?|part|trace|checksum|commit|range|line|ticket|issue|port|sku|listen on|eta|to)[ \t]*[:#=]?[ \t]*)$",
    re.I,
)
_PHONES = [
    re.compile(r"(?<![\w+./\-])(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\(?\d{1,9}\)?){1,6}(?!\w)"),
    re.compile(r"(?<![\w+./\-])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?![\w]|[.\-]\d)"),
    re.compile(r"(?<![\w+./\-])\d{3}([\-.])\d{3}\1\d{4}(?![\w]|[.\-]\d)"),
    re.compile(r"(?<![\w+./:\-])0\d{1,4}[ /\-]?\d{3,8}(?:[ \-]\d{2,8}){0,3}(?![\w]|[.\-]\d)"),
]
#: Ten digits in the North American plan: area code and exchange begin with 2 to 9.
_BARE_PHONE = re.compile(r"(?<![\w+./\-])[2-9]\d{2}[2-9]\d{6}(?![\w]|[.\-]\d)")
# Words for phones, within three words of the number.
_PHONE_WORD = r"(?:\b(?:call|dial|phone|tel|mobile|móvil|movil|cell|sms|text|fax|whatsapp|signal|reach|contact|hotline|on-call|number|rückruf|anruf|telefon|handy|teléfono|llama|téléphone|portable|appel)\b\.?|电话|手机|致电|联系)"
_PHONE_CUE = re.compile(rf"{_PHONE_WORD}\W{{0,3}}(?:\w+\W{{1,2}}){{0,3}}$", re.I)
_PHONE_CUE_AFTER = re.compile(rf"\W{{1,3}}(?:\w+ ){{0,3}}{_PHONE_WORD}", re.I)
# Digits of a number with country code, the code included.
COUNTRY_DIGITS = {"1": 11, "7": 11, "33": 11, "34": 11, "44": 12, "49": 13, "52": 12, "61": 11, "81": 12, "86": 13, "91": 12, "353": 12}

_CARD = re.compile(r"(?<![\w.\-])(?:\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ \-]?)\d{6}\2\d{5})(?![\w]|[.\-]\d)")
_IDS = [
    re.compile(r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w]|[.\-]\d)"),
    re.compile(r"(?<![\w.\-])\d{6}-\d{4}(?![\w]|[.\-]\d)"),
    re.compile(r"(?<![\w.\-])[A-Z]\d[A-Z]\d{2}[A-Z]\d{3}(?![\w\-])"),
    re.compile(r"(?<![\w.\-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w\-])"),
]
#: Forms that count only near a word for an identity number.
_CUED_IDS = [
    re.compile(r"(?<![\w.\-])\d{3} \d{2} \d{4}(?![\w]|[.\-]\d)"),
    re.compile(r"(?<![\w.\-])\d{2} \d{3} \d{3} \d{3}(?![\w]|[.\-]\d)"),
    re.compile(r"(?<![\w.\-])\d{8}-?[A-Z](?![\w\-])"),
    re.compile(r"(?<![\w.\-])[A-Z]{1,2}\d{6,8}(?![\w\-])"),
    re.compile(r"(?<![\w.\-])\d{4} \d{4} \d{4}(?![\w]|[.\-]\d| \d{4})"),
    re.compile(r"(?<![\w.\-])\d{17}[\dXx](?!\w)"),
    re.compile(r"(?<![\w.\-])\d{9,11}(?![\w]|[.\-]\d)"),
]
#: From here on the forms are plain digits.
PLAIN_IDS = 4
_ID_CUE = re.compile(r"national id|identity|\btax\b|passport|pasaporte|reisepass|\bID\b|id number|documento|\bDNI\b|\bNIE\b|ausweis|\bSSN\b|social security|steuer|身份证|护照", re.I)

# Words for streets.
_STREET_TYPE = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Way|Court|Ct|Place|Pl|Terrace|Square|Sq|Row|Close|Crescent|Hill|Gardens|Mews|Highway|Hwy|Parkway|Pkwy)"
_STREET_ES = r"(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Cc]arrer|[Cc]arretera|C/)"
_STREET_FR = r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Bb]d|[Pp]lace|[Qq]uai|[Ii]mpasse|[Aa]llée|[Cc]hemin|[Cc]ours|[Ss]quare)"
_TOWN = r"[A-ZÄÖÜÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-Za-zÄÖÜÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*"
_UNIT = r"(?:,\s+(?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|No)\.?\s?\w{1,5}|,\s+#\d{1,5}\w?)?"
_ADDRESSES = [
    re.compile(
        rf"(?<![\w\-])\d{{1,5}}[A-Za-z]? (?:[A-Z][\w'’\-]+ ){{1,3}}{_STREET_TYPE}\.?{_UNIT},\s+(?:{_TOWN}(?: {_TOWN}){{0,2}}?,?\s+(?:[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}})|{_TOWN})(?![\w])"
    ),
    re.compile(rf"(?<![\w\-])[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|hof) \d{{1,4}}[a-z]?,\s+\d{{5}} {_TOWN}"),
    re.compile(rf"(?<![\w\-]){_STREET_ES} ?(?:(?:de|del|la|las|los|el) )*[A-ZÁÉÍÓÚÑ]\w+(?: (?:(?:de|del|la|las|los) )*[A-ZÁÉÍÓÚÑ]\w+){{0,2}},? (?:n\.?º ?)?\d{{1,4}}(?:,\s+\d{{1,2}}º(?: ?\w)?)?,\s+\d{{5}} {_TOWN}"),
    re.compile(rf"(?<![\w\-])\d{{1,4}}(?: ?(?:bis|ter))?,? {_STREET_FR} (?:(?:de la|de l['’]|des|du|de|d['’]|la|le) ?)?[\wÀ-ÿ'’\-]+(?: [\wÀ-ÿ'’\-]+){{0,3}},?\s+\d{{5}} {_TOWN}"),
]
#: Chinese: province or city, district, road and number, and what is behind it (building, room).
_ADDRESS_ZH = re.compile(r"(?:[一-鿿]{2,8}?(?:省|自治区))?[一-鿿]{2,6}?市(?:[一-鿿]{1,6}?[区县])?[一-鿿]{1,10}?(?:路|街|大道|巷|弄)\d{1,5}号(?:[一-鿿]{0,8}?\d{0,4}(?:号?楼|栋|座|单元|室|层)){0,4}")

_POSTCODE_TOWN = re.compile(r"\d{5} [A-ZÄÖÜ]")

_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_PART = rf"(?:O['’]{_CAP}|(?:Mc|Mac|De|Van|Von){_CAP}|{_CAP})"
_FAMILY = rf"(?:{_PART}(?:-{_PART})*|[A-ZÀ-ÖØ-Þ]{{3,}}(?:['’\-][A-ZÀ-ÖØ-Þ]{{2,}})*|O['’][A-Z]{{2,}})"
_GIVEN = rf"{_CAP}(?:-{_CAP})?"
_INITIALS = r"(?: [A-Z]\.)*"
_NAME = rf"(?:{_FAMILY}, {_GIVEN}{_INITIALS}(?![\w])|{_GIVEN}{_INITIALS} {_FAMILY}(?![\w'’\-]))"
# Titles; words for people and their parts in a text; verbs that have a person as object or subject; greetings and
# closings. A pair of capitalised words beside one of them is a name.
_TITLES = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Sir|Sr|Sra|Frau|Herr|Señor|Señora|Don|Doña|M|Mme|Monsieur|Madame)\.?"
PEOPLE = "customer client colleague contact user patient tenant guest employee engineer developer manager director teammate kollege kollegin kunde kundin cliente compañero compañera collègue".split()
FIELDS = "name owner author assignee reporter reviewer contact customer client employee user manager signer sender recipient approver attn".split()
OBJECT_OF = "ask tell thank ping page call email mail contact meet message notify remind invite cc frag frage pregunta pide avisa demande".split()
AFTER_VERB = ["to", "by", "with", "from", "von", "bei", "mit", "por", "con", "a", "par", "avec"]
VERBS_BEFORE = "belongs thanks assigned escalated goes handed sent forwarded paired reported written signed approved reviewed filed met spoke worked gemeldet geschrieben reportado escrito".split()
SAID = "wrote said says asked asks reported reports complained complains signed signs thinks thought suggested suggests confirmed replied answered mentioned called emailed approved wants wanted noticed hat schrieb sagte fragte meldete escribió dijo preguntó pidió perdió écrit demandé".split()
REQUESTED = "pidió dijo escribió preguntó reportó avisó".split()
GREETINGS = ["regards", "best", "cheers", "sincerely", "yours", "thanks", "grüße", "gruß", "saludos", "cordialement"]
SALUTATIONS = ["dear", "hi", "hello", "hey", "liebe", "lieber", "hola", "estimado", "estimada", "bonjour", "cher", "chère"]

_any_of = lambda words: "|".join(sorted(words, key=len, reverse=True))
_NAME_BEFORE = (
    rf"(?:{_TITLES} |(?:{_any_of(VERBS_BEFORE)}) (?:{_any_of(AFTER_VERB)}) |(?:{_any_of(REQUESTED)}) |(?:{_any_of(PEOPLE)}) |(?:{_any_of(GREETINGS)}),\s+"
    rf"|(?:{_any_of(FIELDS)})[\"']?[ \t]*[:=][ \t]*[\"']?|(?:{_any_of(OBJECT_OF)}) |(?:{_any_of(SALUTATIONS)}) )"
)
#: What follows a name in front of a sentence: a verb, or an auxiliary and a verb form.
_NAME_AFTER = rf" (?:(?:{_any_of(SAID)})\b|(?:will|would|can|could|has|had|is) (?:already |also |now |not )?[a-z]{{3,}}\b)"
_LEAD = re.compile(rf"(?<![\w\-])(?i:{_NAME_BEFORE})(?:{_TITLES} )?")
_FED = re.compile(_NAME_AFTER)
_NAME_HERE = re.compile(rf"({_NAME})")
_NAME_END = re.compile(rf"(?<![\w'’.\-/@])({_NAME})$")
_CAPITALS = re.compile(_CAP)
#: Two capitalised words side by side: without them a text holds no name in Latin letters.
_PAIR = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?: [A-Z]\.)*,? [A-ZÀ-ÖØ-Þ]|[A-ZÀ-ÖØ-Þ]{2,},? [A-ZÀ-ÖØ-Þ]")
_NAME_ANY = re.compile(rf"(?<![\w'’.\-/@])(?={_CAP})(?=({_NAME}))")
# The hundred most frequent Chinese family names, and words beside Chinese names.
SURNAMES_ZH = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_NAME_ZH = re.compile(rf"(?:(?:姓名|联系人|收件人|客户|同事|负责人|我叫|名叫|请找|请联系|作者)[:：是为]?\s?([{SURNAMES_ZH}][一-鿿]{{1,2}})(?![一-鿿])|(?<![一-鿿])([{SURNAMES_ZH}][一-鿿]{{1,2}})(?:先生|女士|小姐|老师|医生|经理|工程师))")
# Capitalised words that begin sentences or name things, and are no part of a name.
NOT_NAMES = set(
    "The This That These Those Our Your Their My His Her Its We He She They It Please When While Why What Which Where Who How Can Could Would Should Use Keep Read Reading Return Rename Replace Write Split Show Treat Check Add Act Do Does Did If For From Between Both Only Nothing Everything Next After Before Under Over Log Lines Instead Follow Thanks Regards Cheers Dear Hi Hello Ask Call Reach Send Ship And But Or Not No Yes Then Also Now Today Tomorrow Yesterday With Without In On At To By As Is Are Was Be "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December "
    "Bitte Bei Nach Der Die Das Und Ich Wir Warum Wie Zwischen Fasse Schreibe El La Los Las Un Una Lo Por Para Revisa Quiero Despues Después Le Les Une Des Tel Fax Phone Mail Dr Mr Mrs Ms Frau Herr Apt Suite Unit "
    "Theme Toolkit Library Framework Package Module Project Product Release Version Edition Plugin Driver Engine Protocol Cluster Server Service Team Group Inc Ltd Corp Company University Street Road Avenue".split()
)
#: Names that are everyday words too. Two of them side by side are a name only beside one of the words above.
EVERYDAY = {"will", "grace", "rose", "mark", "stone", "marsh", "field", "hope", "joy", "may", "june", "art", "bill", "frank", "faith", "summer", "chase", "hill", "brook", "woods", "page", "price", "banks", "day", "long", "young"}


def luhn(number: str) -> bool:
    """Whether the check digit of a number is right."""
    total = 0
    for i, ch in enumerate(reversed([c for c in number if c.isdigit()])):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    if "@" not in t:
        return
    for m in _EMAIL.finditer(t):
        domain = m[2].lower()
        if any(domain == d or domain.endswith("." + d) for d in PLACEHOLDER_DOMAINS):
            continue
        # Remotes: user@host:path, or user@host/path behind a scheme.
        if re.match(r":(?!\s)[\w~./]", t[m.end() : m.end() + 3]) or t[max(0, m.start() - 3) : m.start()].endswith("://"):
            continue
        yield m.span()


_LONG = re.compile(r"(?:\d[ ().\-/]{0,2}){7}")
_CODED = re.compile(r"[A-Z]\d[A-Z]\d|[A-Z] ?\d{2} ?\d{2}|\d-?[A-Z](?![\w\-])")


def _idnums(t: str) -> Iterator[tuple[int, int]]:
    if not _CODED.search(t) and not _LONG.search(t):
        return
    for m in _CARD.finditer(t):
        if luhn(m[0]):
            yield m.span()
    for p in _IDS:
        for m in p.finditer(t):
            if not _REJECT_BEFORE.search(t[max(0, m.start() - 24) : m.start()]):
                yield m.span()
    if _ID_CUE.search(t):
        for k, p in enumerate(_CUED_IDS):
            for m in p.finditer(t):
                before = t[max(0, m.start() - 42) : m.start()]
                # Plain digits need the word right before them.
                around = before[-20:] if k >= PLAIN_IDS else before + "\0" + t[m.end() : m.end() + 42]
                if _ID_CUE.search(around) and not _REJECT_BEFORE.search(before[-24:]) and not (k >= PLAIN_IDS and _PHONE_CUE.search(before)):
                    yield m.span()


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _phones(t: str) -> Iterator[tuple[int, int]]:
    if not _LONG.search(t):
        return
    for k, p in enumerate(_PHONES):
        for m in p.finditer(t):
            start, end = m.span()
            if _REJECT_BEFORE.search(t[max(0, start - 24) : start]) and not _PHONE_CUE.search(t[max(0, start - 40) : start]):
                continue
            if k == 0:
                code = re.sub(r"\D", "", m[0])[2 if m[0].startswith("00") else 0 :]
                most = next((COUNTRY_DIGITS[code[:n]] for n in (3, 2, 1) if code[:n] in COUNTRY_DIGITS), 15) + (2 if m[0].startswith("00") else 0) + m[0].count("(0)")
                # Numbers that follow are cut off group by group.
                while _digits(t[start:end]) > most:
                    cut = max(t.rfind(c, start, end) for c in " .-/")
                    if cut <= start:
                        break
                    end = cut
                if not 9 <= _digits(t[start:end]) <= most:
                    continue
            elif k == 3:
                while _digits(t[start:end]) > 12:
                    cut = max(t.rfind(c, start, end) for c in " -")
                    if cut <= start:
                        break
                    end = cut
                if not 9 <= _digits(t[start:end]) <= 12:
                    continue
            yield start, end
    for m in _BARE_PHONE.finditer(t):
        before = t[max(0, m.start() - 40) : m.start()]
        if _PHONE_CUE.search(before) or (_PHONE_CUE_AFTER.match(t, m.end()) and not _REJECT_BEFORE.search(before)):
            yield m.span()


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    for m in _ADDRESSES[0].finditer(t):
        yield m.span()
    if _POSTCODE_TOWN.search(t):
        for p in _ADDRESSES[1:]:
            for m in p.finditer(t):
                yield m.span()
    if "号" in t:
        for m in _ADDRESS_ZH.finditer(t):
            yield m.span()


class Names:
    """The detector of names; lexicon: known given and family names, which need no word beside them that announces a name."""

    def __init__(self, lexicon: Iterable[tuple[str, str]] = ()) -> None:
        lexicon = [(t, k) for t, k in lexicon if t]
        self.given = {t.casefold() for t, k in lexicon if k == "given"}
        self.family = {t.casefold() for t, k in lexicon if k == "family"}
        self.tokens = self.given | self.family

    def __call__(self, t: str) -> Iterator[tuple[int, int]]:
        if not t.isascii():
            for m in _NAME_ZH.finditer(t):
                yield m.span(1 if m[1] else 2)
        if not _PAIR.search(t):
            return
        for lead in _LEAD.finditer(t):
            m = _NAME_HERE.match(t, lead.end())
            if m and self._may(m[1]):
                yield m.span(1)
        for fed in _FED.finditer(t):
            begin = max(0, fed.start() - 80)
            m = _NAME_END.search(t[begin : fed.start()])
            if m and self._may(m[1]):
                yield begin + m.start(1), begin + m.end(1)
        if self.tokens and any(w.casefold() in self.tokens for w in _CAPITALS.findall(t)):
            for m in _NAME_ANY.finditer(t):
                if self._may(m[1]) and self._known(m[1]):
                    yield m.span(1)

    @staticmethod
    def _may(name: str) -> bool:
        return not any(w in NOT_NAMES for w in re.split(r"[ ,]+", name))

    def _known(self, name: str) -> bool:
        family, given = name.split(", ") if ", " in name else name.rsplit(" ", 1)[::-1]
        given, families = given.split(" ")[0].casefold(), {family.casefold(), *family.casefold().split("-")} & self.family
        return given in self.given and bool(families) and not (given in EVERYDAY and families <= EVERYDAY)


def find(text: str | None, names: Names | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item in the source text, in order, none overlapping another."""
    if text is None or not text or text.isspace():
        return []
    a = normalise(text)
    names = names or Names()
    taken: list[tuple[int, int, str]] = []
    for kind, detect in zip(KINDS, (_emails, _idnums, _phones, _addresses, names), strict=True):
        for s, e in sorted(set(detect(a.text)), key=lambda x: (x[0], -x[1])):
            if all(e <= x or s >= y for x, y, _ in taken):
                taken.append((s, e, kind))
    return [(*a.span(s, e), kind) for s, e, kind in sorted(taken)]


def redact_text(text: str | None, names: Names | None = None) -> str | None:
    """The text with [EMAIL], [PHONE], [IDNUM], [ADDRESS] and [NAME] for its items."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in find(text, names):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


# Tables -------------------------------------------------------------------------------------------------------------------------
#: Rows of the lexicon that are sent to the tasks; a greater lexicon is refused, as names beyond it would go unseen.
MAX_LEXICON = 1_000_000


def _names(lexicon: DataFrame | None) -> Names:
    if lexicon is None:
        return Names()
    rows = lexicon.select("token", "kind").limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"a lexicon may have {MAX_LEXICON} rows")
    return Names([(r["token"], r["kind"]) for r in rows])


def items(df: DataFrame, keys: list[str], text: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """(*keys, kind, val): each distinct item of every text, exactly as it stands there."""
    rows = df.select(*keys, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    names = df.sparkSession.sparkContext.broadcast(_names(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, vals = [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                for kind, val in dict.fromkeys((kind, t[s:e]) for s, e, kind in find(t, names.value)):
                    at.append(i)
                    kinds.append(kind)
                    vals.append(val)
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(idx) for k in keys], pa.array(kinds, pa.string()), pa.array(vals, pa.string())], names=[*keys, "kind", "val"])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.drop("_text").schema.fields)
    return rows.mapInArrow(run, f"{schema}, kind string, val string")


def redact(df: DataFrame, text: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """df with column text redacted."""
    names = df.sparkSession.sparkContext.broadcast(_names(lexicon))
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(where, text, pa.array([redact_text(t, names.value) for t in b.column(where).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)
