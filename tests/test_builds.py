from __future__ import annotations

from verbarium.operators import builds as B
from verbarium.operators import transcripts as T


def test_transcript_graph_and_chat_files(spark):
    p = T.parse(spark.createDataFrame([("My Talk.txt", "Speakers:\nA: An [Anna] (x) #an\nPRELIMINARIES\nMAIN\nA: hi")], "doc string, text string"))
    e, props = B.transcript_graph(p)
    assert sorted(r.id for r in e.collect()) == ["#an", "#my-talk", "#my-talk-annotation", "My Talk.txt", "_outputs/csv/My Talk.csv"]
    got = {(r.id, r.key, r.value or r.ref) for r in props.collect()}
    assert {("#my-talk", "speaker", "#an"), ("#an", "alternateName", "Anna"), ("#an", "description", "x"), ("#my-talk", "hasPart", "_outputs/csv/My Talk.csv"), ("#my-talk-annotation", "annotationBody", "_outputs/csv/My Talk.csv"), ("_outputs/csv/My Talk.csv", "isPartOf", "#my-talk")} <= got
    docs = spark.createDataFrame([("My Talk.txt",), ("none.txt",)], "doc string")
    for _ in range(2):  # a second time adds nothing
        e, props = B.add_chat_files(e, props, docs)
    assert [(r.ord, r.ref) for r in props.where("key = 'hasPart' and ref like '%.cha'").collect()] == [(2, "_outputs/chat/My Talk.cha")] and e.where("id like '%.cha'").count() == 2
    people = T.person_entities(p["speakers"])
    fields = spark.createDataFrame([("#an", "Year of birth", "1980"), ("#an", "Note", ""), ("#no", "x", "y")], "id string, label string, value string")
    e2, p2 = B.custom_values(people, fields)
    assert [r.id for r in e2.collect()] == ["#an-year-of-birth"] and {(r.key, r.value or r.ref) for r in p2.collect()} == {("additionalProperty", "#an-year-of-birth"), ("name", "Year of birth"), ("value", "1980")}


def test_workbook_graph(spark):
    rows = spark.createDataFrame([("Person", 1, ["@id", "name", "knows"]), ("Person", 2, ["#a", "An", "#b"]), ("Person", 3, ["#b", "Bo", '["#a","#z"]']), ("Person", 4, ["", "x", ""]), ("File", 1, ["@id", "@type"]), ("File", 2, ["f.txt", "File, X"])], "sheet string, row_no int, cells array<string>")
    e, p = B.workbook_graph(rows)
    assert {r.id: sorted(r.types) for r in e.collect()} == {"#a": ["Person"], "#b": ["Person"], "f.txt": ["File", "X"]}
    assert sorted((r.id, r.key, r.ord, r.value, r.ref) for r in p.collect()) == [("#a", "knows", 0, None, "#b"), ("#a", "name", 0, "An", None), ("#b", "knows", 0, None, "#a"), ("#b", "knows", 1, "#z", None), ("#b", "name", 0, "Bo", None)]


def test_links(spark):
    html = '<a href="my%20file.txt#top">x</a><img src=\'a&amp;b.png\'><p style="background:url( c.png )"><a href="other">'
    links = [("p", "my file.txt", "files/my file.txt"), ("p", "a&b.png", "files/1.png"), ("p", "c.png", "files/c.png"), ("q", "other", "no")]
    out = B.rewrite_pages(spark.createDataFrame([("p", html), ("r", None)], "path string, html string"), spark.createDataFrame(links, "path string, source string, target string"))
    got = {r.path: r.html for r in out.collect()}
    assert got == {"p": '<a href="files/my%20file.txt#top">x</a><img src=\'files/1.png\'><p style="background:url( files/c.png )"><a href="other">', "r": ""}
