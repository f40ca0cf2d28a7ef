import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from talkframe.functions import entities as E
from talkframe.functions import text as X
from talkframe.operators import analysis as A
from talkframe.operators import chunking as C
from talkframe.operators import quality as Q
from talkframe.operators import values as V
from talkframe.session import runs_in_tasks

runs_in_tasks(__name__)

a, b, c = F.col("a"), F.col("b"), F.col("c")


def each(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, a string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_match_form(spark):
    cases = {
        "48.250 tonluk": "48250 tonluk",
        "%3.6'dan": "%3,6dan",
        "yüzde 61": "%61",
        "% 9": "%9",
        "Kuzey Kapısı'ndayız": "kuzey kapısındayız",
        "9.876.543": "9876543",
        "7.654.321.098": "7654,321098",
        "98 765 432 1098": "98765432 1098",
        "a, 5,3 ,4 ,": "a 5,3 4",
        "ISPARTA İnegöl": "ısparta inegöl",
        "söz, söz -- %": "söz söz %",
        "": "",
    }
    assert each(spark, X.match_form(a), cases) == list(cases.values())


def test_thousands_reach_a_fixpoint(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("12. ") for _ in range(rng.randint(1, 30))) for _ in range(300)]

    def closed(v):
        while True:
            w = re.sub(r"(\d)[.\s](\d{3})(?!\d)", r"\1\2", v)
            if w == v:
                return v
            v = w

    assert each(spark, X.close_thousands(a), texts) == [closed(t) for t in texts]


def test_compare_line(spark):
    cases = {
        "beş soru": "5 soru",
        "kırk iki vagon": "42 vagon",
        "yüz doksan": "190",
        "altı bin dört yüz seksen": "6480",
        "bin": "1000",
        "yüzde sekiz": "%8",
        "% 2 % 9": "%2 %9",
        "%45": "%45",
        "6.200": "6200",
        "8.300.000": "8300000",
        "Olur. Hadi!": "olur hadi",
        "onlardan onuncusu": "onlardan onuncusu",
        " ": "",
    }
    assert each(spark, X.compare_line(a), cases) == list(cases.values())


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        prev, row = row, [i]
        for j, q in enumerate(y, 1):
            row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (p != q)))
    return row[-1]


def test_word_errors_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "ab", "ş", "k9", "z"]) for _ in range(rng.randint(0, 25))), " ".join(rng.choice(["a", "ab", "ş", "q"]) for _ in range(rng.randint(0, 20)))) for i in range(80)]
    rows += [(80, "a b", None), (81, "", ""), (82, "x", ""), (83, " ".join(f"w{i}x" for i in range(900)), " ".join(f"w{i}x" for i in range(0, 900, 2)))]
    df = spark.createDataFrame(rows, "i int, text string, reference string")
    for r in Q.word_errors(df).collect():
        if r.reference is None:
            assert r.wer is None and r.distance is None
            continue
        h, m = r.text.split(), r.reference.split()
        assert r.distance == distance(h, m)
        assert r.wer == pytest.approx(distance(h, m) / len(m) if m else float(len(h) > 0))


def test_long_texts_by_columns_of_bits(spark):
    rng = random.Random(21)
    for _ in range(400):
        x, y = ([rng.choice("klmn") for _ in range(rng.randrange(40))] for _ in range(2))
        assert Q.bit_distance(x, y) == distance(x, y)
    words = [f"w{rng.randrange(900)}" for _ in range(6000)]
    changed = [w for i, w in enumerate(words) if i % 50 != 7]  # 120 are missing
    changed[1000:1000] = ["new", "words", "here"]
    changed[3000] = "other"
    rows = [(0, " ".join(words), " ".join(changed)), (1, " ".join(words[:1500]), " ".join(reversed(words[:1500]))), (2, "", " ".join(words)), (3, " ".join(words), ""), (4, None, " ".join(words)), (5, " ".join(words), None)]
    got = {r.i: r.distance for r in Q.word_errors(spark.createDataFrame(rows, "i int, text string, reference string")).collect()}
    assert got[0] == 124 and got[1] == distance(words[:1500], words[1499::-1])
    assert (got[2], got[3], got[5]) == (6000, 6000, None)


def test_terms_and_invented_sentences(spark):
    runs = spark.createDataFrame([("r", "S", "Kavanoz kilere girdi, bekleme 4 hafta.", "Kavanoz mahzene girdi. Dört hafta sonra açılır.")], "id string, scenario string, text string, reference string")
    terms = spark.createDataFrame([("S", "kavanoz"), ("S", "mahzen"), ("S", "dört hafta")], "scenario string, term string")
    r = Q.term_recall(runs, terms, ["id"]).collect()[0]
    assert (r.found, r.total) == (2, 3)
    none = Q.term_recall(runs, terms.limit(0), ["id"]).collect()[0]
    assert (none.found, none.total, none.recall) == (0, 0, 1.0)
    text = "Kavanoz mahzene girdi! 4 hafta sonra açılır. Böyle bir cümle geçmiyordu orada. Bitti işte."
    df = runs.withColumn("text", F.lit(text))
    assert df.select(Q.invented_sentences(F.col("text"), F.col("reference"))).collect()[0][0] == 1


def test_entities(spark):
    cases = {
        "Çatı için doksan altı bin lira istendi, komşu 75 bin lira dedi, kapora 20 bin, 3 haftada biter, vergi %8,5 ve teslim 3 Mart 2027.": [
            "doksan altı bin lira", "75 bin lira", "20 bin", "3 haftada", "%8,5", "3 Mart 2027",
        ],
        "Raf kodu QZ7781. Depoda 620 koli, bunun 150 kolisi ıslak. Müzenin 35 çalışanı geldi.": ["QZ7781", "620 koli", "150 kolisi", "35 çalışanı"],
        "Nem %31’den %36.5’e vardı, 5.5 puanlık fark. Ölçüm 09.11.2027’de yinelenecek.": ["%31", "%36.5", "5.5 puanlık", "09.11.2027"],
        "Bahçıvan Cuma uğrasın. Sınav önümüzdeki çarşamba günü. Pazaryeri doluydu.": ["Cuma", "önümüzdeki çarşamba günü"],
        "PTT’den GSM’e yazdım, borç 870 USD.": ["870 USD"],
        "2027-02-09 ile 2027-02-09, yüzde kırk dört, $ yok": ["2027-02-09", "yüzde kırk dört"],
        "boş cümle": [],
    }
    assert each(spark, E.value_anchors(a), cases) == list(cases.values())


def test_anchor_cap(spark):
    text = ", ".join(f"{i + 1} adet" for i in range(140))
    assert len(each(spark, E.value_anchors(a), [text])[0]) == 100


def test_requests(spark):
    got = each(
        spark,
        E.request_anchors(a),
        ["İlkin gezi anlatıldı. Benim sorum başka. En çok işime yarayacak olan haritayı çevrimdışı açmak. Dağda yolu yitiriyoruz. Ardından çay içildi.", "Benim sorum başka. Peki."],
    )
    assert got[0] == ["Benim sorum başka. En çok işime yarayacak olan haritayı çevrimdışı açmak. Dağda yolu yitiriyoruz. Ardından çay içildi."]
    assert got[1] == ["Benim sorum başka. Peki."]


ORCHARD = (
    "Elmaların sevkini kim izliyor? Kasa kodu MB6092. Bahçeden 8400 kilo çıktı, bunun 2600 kilosu ayıklandı. Depoda 5800 kilo kaldı mı? "
    "21 Ekim, Çarşamba. 2,35 Euro. Hal 900 kilo daha istedi ama %6,5 indirim bekliyor."
)
MERGES = [
    (["kasa kodu: MB6092", "kalan elma: 5800 kilo"], [], ORCHARD, ["kasa kodu: MB6092", "kalan elma: 5800 kilo"]),
    (["birim fiyat: 3,80 Euro"], [], ORCHARD, []),
    (["konum: kuzey kapısı"], [], "Şu an Kuzey Kapısı’ndayız.", ["konum: kuzey kapısı"]),
    (["yük: 48250 ton", "nem: %3,6"], [], "Limanda 48.250 tonluk yük var, nem ise %9’dan %3.6’ya indi.", ["yük: 48250 ton", "nem: %3,6"]),
    (["öğrenci: 25"], [], "Okulda 2500 koltuk var, bu sınıfta 250 kişi oturuyor.", []),
    (["Kira 70 bin lira olarak belirtildi."], [], "Kira 70 bin lira olarak belirtildi ve yazıldı.", []),
    (["cuma: Cuma", "bakım günü: Pazar"], ["Cuma"], "Geziye Cuma çıkalım, bakım Pazar olsun.", ["bakım günü: Pazar", "Cuma"]),
    (["doluluk oranı: yüzde 4", "doluluk oranı: yüzde 6"], ["Yüzde 4", "Yüzde 6"], "Doluluk ne durumda? Yüzde 4 gibi. Yok, pardon. Yüzde 6’ydı son ölçümde.", ["doluluk oranı: yüzde 6"]),
    (["artış: %21 kadar"], ["%21", "%6,5"], "Artış %21 kadar sürdü, indirim ise %6,5.", ["artış: %21 kadar", "%6,5"]),
    (["bedel: 260 bin euro"], ["60 bin"], "Bedel 260 bin euro, kapora 60 bin.", ["bedel: 260 bin euro", "60 bin"]),
    (["çalışan sayısı: 35"], ["35 çalışanı"], "Müzenin 35 çalışanı geldi.", ["çalışan sayısı: 35"]),
]


@pytest.mark.parametrize("items,anchors,text,want", MERGES)
def test_merge_values(value, items, anchors, text, want):
    typed = lambda x: x.cast("array<string>")
    assert value(V.merge_values(typed(a) if items else F.array().cast("array<string>"), typed(b) if anchors else F.array().cast("array<string>"), X.match_form(c)), a=items or ["x"], b=anchors or ["x"], c=text) == want


def test_merge_cap(value):
    anchors = [f"{i + 1} adet" for i in range(40)]
    assert len(value(V.merge_values(F.array().cast("array<string>"), a, X.match_form(b)), a=anchors, b=", ".join(anchors))) == 24


def test_labels_and_names(value, spark):
    names = F.create_map(F.lit("SPEAKER_1"), F.lit("SPEAKER_10"), F.lit("SPEAKER_10"), F.lit("A$1"))
    assert value(X.rename_labels(a, names), a="SPEAKER_1 ve SPEAKER_10: SPEAKER_100 xSPEAKER_1") == "SPEAKER_10 ve A$1: SPEAKER_100 xSPEAKER_1"
    assert each(spark, X.name_error(a), ["Defne", " ", "x:y", "Speaker 8", "speaker_q"]) == [None, None, "separator", "reserved", None]
    assert each(spark, X.has_line_labels(a), ["q\nDefne K: selam", "dört beş", "[00:07]: z", "Konuşmacı 5: y", "Ek:"]) == [True, False, True, True, False]
    assert each(spark, X.correct_words(a), ["Bu ay fre oranı", "Frene bastı", "Fre oranı compilence."]) == ["Bu ay fire oranı", "Frene bastı", "Fire oranı compliance."]
    assert each(spark, X.split_turns(a), ["Alo -Neredesin on-line - evde", "- q", "q-r"]) == [["Alo", "-Neredesin on-line", "- evde"], ["- q"], ["q-r"]]
    assert each(spark, X.clean_file_name(a), ['a<b>:"c/d', "son. .", "???", "x" * 200]) == ["a b   c d", "son", "toplanti", "x" * 150]
    ids = each(spark, X.timestamp_to_id(X.id_to_timestamp(a)), ["2026-07-14T09-05-00-123Z", "2026-13-14T09-05-00-123Z", "x", "2026-07-14T09:05:00.123Z"])
    assert ids == ["2026-07-14T09-05-00-123Z", None, None, None]


def test_checks(value):
    assert value(X.check_scope(F.lit(None).cast("string"))) == "group"
    assert value(X.check_language(F.lit("foreign"))) == "foreign"
    for bad in (X.check_scope(F.lit("team")), X.check_language(F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="unknown meeting"):
            value(bad)


# --- chunks --------------------------------------------------------------------------------------


def tokens(s, per):
    return -(-len(s) * 10 // int(per * 10))


def cut(text, level, most, per):
    text = text.strip()
    if not text:
        return []
    if tokens(text, per) <= most:
        return [text]
    if level == 5:
        n = max(1, int(most * per))
        return [p for p in (text[i : i + n].strip() for i in range(0, len(text), n)) if p]
    marks = ["\n\n", None, "\n", ". ", " "]
    if level == 1:
        parts = re.split(r"(?=\nSPEAKER_)", text)
    else:
        parts = [p + marks[level] for p in text.split(marks[level])]
        parts[-1] = parts[-1][: -len(marks[level])]
    parts = [p.strip() for p in parts if p.strip()]
    if len(parts) <= 1:
        return cut(text, level + 1, most, per)
    return [q for p in parts for q in ([p] if tokens(p, per) <= most else cut(p, level + 1, most, per))]


def chunk(text, most, overlap, per):
    packed, current = [], ""
    for part in cut(text, 0, most, per):
        joined = re.sub(r"\s+", " ", f"{current} {part}").strip()
        if not current:
            current = part
        elif tokens(joined, per) <= most:
            current = joined
        else:
            packed.append(current)
            current = part
    packed += [current] if current else []
    if len(packed) <= 1 or overlap <= 0:
        return packed
    out = packed[:1]
    for nxt in packed[1:]:
        taken, used = [], 0
        for s in reversed([s for s in re.split(r"(?<=[.!?])\s+", out[-1]) if s]):
            taken.insert(0, s)
            used += tokens(s, per)
            if used >= overlap:
                break
        tail = " ".join(taken).strip()
        out.append(nxt if not tail or nxt.startswith(tail) else re.sub(r"\s+", " ", f"{tail} {nxt}").strip())
    return out


def test_chunks_match_a_plain_loop(spark):
    rng = random.Random(13)
    glue = [" ", " ", " ", ". ", "! ", "\n", "\n\n", "\nSPEAKER_01: ", "  "]
    texts = ["".join("".join(rng.choice("abcde") for _ in range(rng.choice([2, 4, 9, 30]))) + rng.choice(glue) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for most, overlap, per in ((12, 0, 3.5), (20, 6, 3.0), (40, 10, 1.0), (5, 2, 2.5)):
        got = each(spark, C.chunk_array(a, most, overlap, per), texts)
        assert got == [chunk(t, most, overlap, per) for t in texts]


# --- drafts --------------------------------------------------------------------------------------


def draft_frame(spark, raw, text="düz metin"):
    return spark.createDataFrame([("d", raw, text)], "doc_id string, raw string, text string").withColumn("draft", A.coerce_draft(F.col("raw")))


def test_coerce_serialize_parse(spark):
    raw = '{"mainRequest":["- Kısa rapor","kısa rapor","<script>x</script>",5,null,"Tespit edilmedi."],"decisions":"no","nextSteps":["a\\n  b"],"other":[1]}'
    df = draft_frame(spark, raw).withColumn("md", A.serialize_draft(F.col("draft"))).withColumn("back", A.parse_draft(F.col("md")))
    r = df.collect()[0]
    assert r.draft.mainRequest == ["Kısa rapor", "&lt;script&gt;x&lt;/script&gt;"]
    assert r.draft.decisions == [] and r.draft.nextSteps == ["a b"]
    assert r.md.count("### ") == 9 and r.md.count("- Tespit edilmedi.") == 7
    assert r.back == r.draft
    for broken in ("not json", "[1]", None):
        assert draft_frame(spark, broken).collect()[0].draft.mainRequest == []
    counts = A.section_counts(df, ["doc_id"]).orderBy("section_idx").collect()
    assert [x["items"] for x in counts] == [2, 0, 0, 0, 0, 0, 0, 1, 0] and counts[0].filled_sections == 2 and counts[0].total_items == 3
    replaced = df.select(A.replace_section(F.col("draft"), "decisions", F.array(F.lit(" x "), F.lit(" "))).alias("d")).collect()[0].d
    assert replaced.decisions == ["x"] and replaced.mainRequest == r.draft.mainRequest


def test_moved_actions(spark):
    raw = '{"actionItems":["Arşive taşınacak (Konuşmacı: Peki).","**Ali** arar","arşive TAŞINACAK (speaker: q)"],"nextSteps":["b"]}'
    moved = draft_frame(spark, raw, "Peki öyleyse").select(A.move_unlabeled_actions(F.col("draft"), F.col("text")).alias("d")).collect()[0].d
    assert moved.actionItems == ["**Ali** arar"] and moved.nextSteps == ["b", "Arşive taşınacak"]
    kept = draft_frame(spark, raw, "Ali: tamam").select(A.move_unlabeled_actions(F.col("draft"), F.col("text")).alias("d")).collect()[0].d
    assert len(kept.actionItems) == 3


def fake(system, user, schema):
    if "boom" in user:
        raise A.ExtractorError("no such model")
    if user.startswith("Merge"):
        return {"mainRequest": ["merged"], "contextAndTopics": [f"{user.count('--- Partial')} parts"]}
    if user.startswith("Transcript part"):
        return {"contextAndTopics": [user.split("\n")[0]]}
    return {"mainRequest": ["Rapor"], "detectedValues": ["konaklama: **45 bin lira**", "ulaşım: 800 bin lira"]}


def test_analysis_job(spark):
    long = " ".join(f"Gezinin {i + 1}. durağı ve oradaki müze uzun uzun anlatıldı." for i in range(300))
    docs = spark.createDataFrame([("short", "Mert bileti akşam alacak. Konaklama 45 bin lira."), ("long", long), ("bad", "boom")], "doc_id string, text string")
    for ctx in (6144, 4300):
        out = {r.doc_id: r for r in A.analyze(docs, fake, A.AnalysisConfig(num_ctx=ctx, chunk_tokens=128, retries=0)).collect()}
        assert out["short"].draft.detectedValues == ["konaklama: **45 bin lira**"]
        assert out["long"].status == "success" and out["long"].draft.mainRequest == ["merged"]
        assert out["long"].markdown.count("### ") == 9
        assert (out["bad"].status, out["bad"].error, out["bad"].markdown) == ("failed", "no such model", None)


class Counted:
    """An extractor that notes each call in a folder and dies at one prompt, as a lost executor would."""

    def __init__(self, folder, dies_at=None):
        self.folder, self.dies_at = folder, dies_at

    def __call__(self, system, user, schema):
        if self.dies_at and self.dies_at in user:
            raise KeyboardInterrupt
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(user)
        return fake(system, user, schema)


def test_no_logged_prompt_is_called_twice(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    told = lambda: sorted(p.read_text() for p in notes.iterdir())
    long = " ".join(f"Yolun {i + 1}. kilometresinde durup çevreye baktık." for i in range(120))
    docs = spark.createDataFrame([(f"d{i}", f"Metin {i % 25} burada.") for i in range(40)] + [("long", long), ("bad", "boom")], "doc_id string, text string")
    config = A.AnalysisConfig(num_ctx=4300, chunk_tokens=128, retries=0, log=str(tmp_path / "log"), log_batch=7)
    with pytest.raises(Exception, match="."):
        A.analyze(docs, Counted(str(notes), dies_at="durup"), config).collect()
    first = told()
    logged = A.call_log(spark, config.log).count()
    assert len(first) == logged == 26  # equal texts are one call
    out = {r.doc_id: r for r in A.analyze(docs, Counted(str(notes)), config).collect()}
    again = told()
    assert all(again.count(x) == 1 for x in first if "boom" not in x) and len(again) > len(first)
    plain = {r.doc_id: r for r in A.analyze(docs, fake, A.AnalysisConfig(num_ctx=4300, chunk_tokens=128, retries=0)).collect()}
    assert {k: (r.status, r.markdown, r.error) for k, r in out.items()} == {k: (r.status, r.markdown, r.error) for k, r in plain.items()}
    third = A.analyze(docs, Counted(str(notes)), config).collect()
    assert len(third) == 42 and [x for x in told() if "boom" not in x] == [x for x in again if "boom" not in x]


def test_null_text_keeps_its_analysis(spark):
    docs = spark.createDataFrame([("none", None), ("some", "Bilet alındı.")], "doc_id string, text string")
    out = A.analyze(docs, fake, A.AnalysisConfig(retries=0)).collect()
    assert {r.doc_id for r in out} == {"none", "some"}


def test_retry():
    calls = []

    def flaky(system, user, schema):
        calls.append(1)
        if len(calls) < 3:
            raise A.ExtractorError("busy", retryable=True)
        return "{}"

    assert A.call_with_retry(flaky, "", "", 2, 0.0) == ("{}", None)
    assert A.call_with_retry(lambda *_: 1 / 0, "", "", 2, 0.0) == (None, "division by zero")


def test_group_packing(value):
    config = A.AnalysisConfig(num_ctx=4196, system="")  # 350 characters fit
    got = value(A.pack_groups(a.cast("array<bigint>"), 0, config), a=[100, 200, 100, 400, 10, 10])
    assert got == [0, 0, 1, 2, 3, 3]


def test_a_mark_in_a_text_changes_nothing(value):
    assert value(X.correct_words(F.col("a")), a="fre a\x01b fre c") == "fire a\x01b fire c"
    names = F.create_map(F.lit("SPEAKER_1"), F.lit("Ada"))
    assert value(X.rename_labels(F.col("a"), names), a="x\x01y SPEAKER_1") == "x\x01y Ada"
    assert value(E.value_anchors(F.col("a")), a="\x01 oran %5 ve 20 kg \x01 sonra %7") == ["%5", "20 kg", "%7"]
    title = A.SECTIONS["nextSteps"]
    assert value(A.parse_draft(F.col("a"))["nextSteps"], a=f"- before\n### {title}\n- a \x01 b\n###\n- c") == ["a \x01 b", "c"]


def test_values_keep_their_first_form_at_any_length(value):
    """More matches than one group of the walk holds, each value many times over."""
    said = " ".join(f"{i % 70 + 1} kg ve {i % 70 + 1}  KG;" for i in range(700))
    assert value(E.value_anchors(F.col("a")), a=said) == [f"{i + 1} kg" for i in range(70)]


def test_texts_that_hold_the_mark_of_a_cut(value):
    text = "12 adet\u0002 ve \u000220 koli"
    assert value(E.value_anchors(F.col("t")), t=text) == ["12 adet", "20 koli"]
    assert value(E.value_anchors(F.col("t")), t=text.replace("\u0002", "")) == ["12 adet", "20 koli"]


def test_numbers_that_overlap(spark):
    cases = {
        "10.11.12.13 ve 05.03.24 günü": ["10.11.12", "05.03.24", "03.24 günü"],
        "1234 567 TL, 1 234 567,50 TL, 12 bin lira": ["234 567 TL", "1 234 567,50 TL", "12 bin lira"],
        "%5 TL; 5.6 kg, ı7 kg; CUMA-123; 9 TLı": ["%5", "5 TL", "5.6 kg", "CUMA-123"],
        "yüzde yüzde beş, 2024-03-05 günü, onbin TL": ["yüzde yüz", "2024-03-05", "05 günü", "bin TL"],
    }
    assert each(spark, E.value_anchors(a), cases) == list(cases.values())


def test_numbers_are_looked_for_in_one_pass(spark):
    text = spark.createDataFrame([("5 kg",)], "a string").select(E.value_anchors(a).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(") <= 6


def test_words_of_claims(value):
    merged = lambda items, text: value(V.merge_values(F.col("a"), E.value_anchors(F.col("t")), X.match_form(F.col("t"))), a=items, t=text)
    text = "ΑΣ:β 5 kg; 1 234 567 890 TL, Tutar 12,5 TL ,3 adet"
    assert merged(["ΑΣ:5 kg", "Tutar,: ,12,5 TL", "yok: 7 kg"], text) == ["ΑΣ:5 kg", "Tutar,: ,12,5 TL", "1 234 567 890 TL", "3 adet"]
    assert merged([" : 3 adet", "8 kg"], text) == [": 3 adet", "5 kg", "1 234 567 890 TL", "12,5 TL"]
