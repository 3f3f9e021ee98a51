"""Personal items in sentences that no rule was written for: recall and precision by kind."""

from parlance.llm import pii

LEXICON = [("Grace", "given"), ("Hopper", "family"), ("Priya", "given"), ("Raman", "family"), ("Will", "given"), ("Stone", "family")]
# Text and the items in it.
HELD_OUT = [
    ("Contact: Grace Hopper", {("name", "Grace Hopper")}),
    ("Priya Raman will fix it", {("name", "Priya Raman")}),
    ("We met with Anna Schmidt about the outage", {("name", "Anna Schmidt")}),
    ("Dear Tomás Ortega, the job is done", {("name", "Tomás Ortega")}),
    ("reviewer: O'Brien, Maeve", {("name", "O'Brien, Maeve")}),
    ("Herr Klaus Weber fragte nach dem Preis", {("name", "Klaus Weber")}),
    ("lo escribió Lucía Fernández", {("name", "Lucía Fernández")}),
    ("请联系王小明，谢谢", {("name", "王小明")}),
    ("张伟经理要求重试", {("name", "张伟")}),
    ("escríbeme a ana.lopez@correo.es", {("email", "ana.lopez@correo.es")}),
    ("j dot doe at mail dot net is mine", {("email", "j dot doe at mail dot net")}),
    ("mail jane@example.com or git@host.net:org/repo", set()),
    ("Ruf an: +49 30 901820", {("phone", "+49 30 901820")}),
    ("call (415) 555-0132 today", {("phone", "(415) 555-0132")}),
    ("order 4155550132 was shipped", set()),
    ("SSN 078-05-1120 on file", {("idnum", "078-05-1120")}),
    ("card 4111 1111 1111 1111 declined", {("idnum", "4111 1111 1111 1111")}),
    ("card 4111 1111 1111 1112 is no card", set()),
    ("12 rue de Rivoli, 75001 Paris", {("address", "12 rue de Rivoli, 75001 Paris")}),
    ("vive en calle Mayor 5, 28013 Madrid", {("address", "calle Mayor 5, 28013 Madrid")}),
    ("Lindenstraße 7, 10969 Berlin", {("address", "Lindenstraße 7, 10969 Berlin")}),
    ("地址：北京市海淀区中关村大街27号", {("address", "北京市海淀区中关村大街27号")}),
    ("12 Baker Street, London", {("address", "12 Baker Street, London")}),
    ("We shipped the Will Stone theme and the Blue Harbor release", set()),
    ("Build 2065550134 failed in Node Exporter", set()),
]


def test_held_out():
    names = pii.Names(LEXICON)
    right, found, true = {}, {}, {}
    for text, want in HELD_OUT:
        got = {(k, text[s:e]) for s, e, k in pii.find(text, names)}
        for kind in pii.KINDS:
            mine, theirs = {x for x in got if x[0] == kind}, {x for x in want if x[0] == kind}
            right[kind] = right.get(kind, 0) + len(mine & theirs)
            found[kind], true[kind] = found.get(kind, 0) + len(mine), true.get(kind, 0) + len(theirs)
    for kind in pii.KINDS:
        assert right[kind] >= 0.9 * true[kind] and right[kind] >= 0.9 * found[kind], (kind, right[kind], found[kind], true[kind])


def test_no_name_is_dropped_from_the_lexicon():
    names = pii.Names([("Rose", "given"), ("Marsh", "family"), ("Tilda", "given")])
    assert names.given == {"rose", "tilda"} and names.family == {"marsh"}
    assert [t for t in ("Tilda Marsh fell", "customer Rose Marsh fell") if pii.find(t, names)] == ["Tilda Marsh fell", "customer Rose Marsh fell"]
