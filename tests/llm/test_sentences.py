"""Sentence units: held-out texts with known boundaries, and what the definition fixes."""

import random

import duckdb
import numpy as np
import pytest

from tramline.llm import sentences
from tramline.llm.sentences import TABLES, Model, forward_backward, sentence_units, text_of, trained, units, units_of

SF = "/root/testdata/sf0.01/documents.parquet"

#: Units by hand, in the languages of the archive; | ends a unit. None is a line of the archive.
HELD_OUT = [
    "Mr. Luroch saw the bus at 7 a.m. in Harrow Park.| It was late.| approx. 12.5 percent of them agreed, e.g. Dr. Varnay.",
    'He said: "Go home. It is over."| "Why now?" asked Tavi.| (The gate was shut.)| Really?!| ok, fine.',
    "See http://status.halden.example/a.html?x=3 for more.| Mail tavi.b@riders.example now!| We waited... and left.| Enough...| Next.",
    "Am 3. März fuhr Fr. Dr. Hessold z. B. nach Köln.| Das war spät.| Er sagte: „Nein, danke.“| Vgl. S. 9 im Heft.",
    "M. Varnay arrive à 6:03.| Quelle chance !| Elle a dit : « Bonjour à tous. »| Où est Mme Luroch ?",
    "¿Dónde está el Sr. Luroch?| ¡Qué retraso!| Véase la pág. 55, p. ej. la tabla.",
    "Мы ждали на ул. Ольховой 9 минут.| «Едем?» — спросил он.| Список и т. д. лежат в шкафу.",
    "Πού είναι το όχημα αρ. 9;| Η πύλη έκλεισε· το κλειδί χάθηκε.| Είπε: «Δεν έρχεται κανείς.»",
    "太晚了！|他说：“别等了。车不来了。”|“还要多久？”乘客问。|我们等了9分钟……后来就走了。",
    "「もう来ません。」と係員が言った。|遅すぎる！|9号車はどこですか？",
    'उसने कहा, "अब कोई नहीं आएगा।"| "क्या बस चली गई?" उसने पूछा।| गाड़ी नं. 9 कहाँ है?',
    "هل البوابة مغلقة؟| الجدول جاهز؛ أرسلوه اليوم.",
    "በጣም ዘገየ!| ርቀቱ 9.5 ኪ.ሜ. ነው።| መኪና ቁጥር 9 የት ነው፧",
    "ฝนตกหนัก| รถสาย 9 ออกเวลา 9:05 จากสถานี| คนขับไม่ได้แจ้ง",
]


@pytest.fixture(scope="module")
def archive():
    return [t[a:b] for t, a, b in duckdb.sql(f"select text, own_start, own_end from '{SF}' order by doc_id").fetchall()]


def test_held_out_boundaries(archive):
    texts = [h.replace("|", "") for h in HELD_OUT]
    got = units(archive + texts)[len(archive) :]
    right = wrong = missed = 0
    for h, t, us in zip(HELD_OUT, texts, got):
        want, pos = set(), 0
        for piece in h.split("|"):
            lead = len(piece) - len(piece.lstrip())
            want.add((pos + lead, pos + len(piece)))
            pos += len(piece)
        right, wrong, missed = right + len(want & set(us)), wrong + len(set(us) - want), missed + len(want - set(us))
    assert 2 * right / (2 * right + wrong + missed) > 0.95, (right, wrong, missed)


@pytest.fixture(scope="module")
def counts(archive):
    return trained(archive)[1]


def texts_of(text, counts):
    return [text[a:b] for a, b in units([text], counts)[0]]


def test_blank_lines_items_and_breaks(counts):
    t = "Hi Tavi,\n\nThe bus\nis late.\r\n \r\nToday:\n1. First thing\n2. Second\nline of it\n\n* A\n* B. C d.\n"
    # "B." is an initial rather than a sentence
    assert texts_of(t, counts) == ["Hi Tavi,", "The bus\nis late.", "Today:", "1. First thing", "2. Second\nline of it", "* A", "* B. C d."]
    assert texts_of("since the old list (cf.\np. 9) was wrong, of zone\n5) we go", counts) == ["since the old list (cf.\np. 9) was wrong, of zone\n5) we go"]


def test_words_of_any_length(counts):
    long = "Pneumono" + "ultra" * 40
    assert texts_of(f"They met {long}. It was late. See http://a.example/{'x' * 300}.html?y=1. We left.", counts) == [f"They met {long}.", "It was late.", f"See http://a.example/{'x' * 300}.html?y=1.", "We left."]


def test_thai_blanks_are_learnt(archive, counts):
    """No rule says what a blank means in Thai: with the Thai texts left out of the counts it ends nothing any more."""
    import re

    t = "ฝนตกหนัก รถสาย 9 ออกเวลา 9:05 จากสถานี คนขับไม่ได้แจ้ง"
    assert texts_of(t, counts) == ["ฝนตกหนัก", "รถสาย 9 ออกเวลา 9:05 จากสถานี", "คนขับไม่ได้แจ้ง"]
    other = trained([a for a in archive if not re.search("[\u0e00-\u0e7f]", a)])[1]
    first, *rest = texts_of(t, other)
    assert first.startswith("ฝนตกหนัก รถสาย") and not any(u.startswith("คนขับ") for u in rest)


def agreement(archive, counts, alter=lambda m: m):
    """Units that agree with those of the model as it is, of both: with the altered model."""
    rows, _ = trained(archive)
    got = []
    for m in (Model(counts), alter(Model({k: v.copy() for k, v in counts.items()}))):
        got.append({(r, x, y) for b in rows for r, x, y in zip(*(v.tolist() for v in units_of(b, m)))})
    return 2 * len(got[0] & got[1]) / (len(got[0]) + len(got[1]))


def test_counts_and_posteriors_decide(archive, counts, monkeypatch):
    def without(*kinds):
        def alter(m):
            for k in kinds:
                m.c[k][:] = 0
            return m

        return alter

    assert agreement(archive, counts) == 1
    assert agreement(archive, counts, without(*TABLES)) < 0.5  # no counts: nothing but what is certain
    assert agreement(archive, counts, without("left", "left_e", "left2", "left2_e", "short", "short_e")) < 0.97  # signs alone
    words = without("start", "start_form", "start2", "begin_all", "begin_form", "mid_all", "mid_form")
    assert agreement(archive, counts, words) < 0.96  # nothing known of the words after
    alone = lambda q0, q1, begins, second, sure, first: np.where(sure >= 0, sure, q0)
    plain = agreement(archive, counts, lambda m: type("Plain", (), {"posteriors": lambda self, x: alone(*m.potentials(x), x.sure, x.first)})())
    assert plain < 0.98  # P(event | words before) as it is, without forward-backward


def test_rows_of_counts_add_up(archive):
    """The counts don't depend on how texts are spread over batches."""
    rows, whole = trained(archive[:200])
    halves = [r for part in (archive[:100], archive[100:200]) for r in trained(part)[0]]
    certain = sentences.tables([c for h in halves for c in sentences.count(None)(iter([h]))])
    for k in ("left", "left_e", "all", "all2", "seed"):
        assert np.allclose(certain[k], whole[k])
    assert text_of(rows[0]).n == sum(r.column("n").to_numpy().sum() for r in halves)


def test_units_cover_every_letter(archive):
    for t, us in zip(archive, units(archive)):
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in us)
        assert all(x[1] <= y[0] for x, y in zip(us, us[1:]))
        inside = set()
        for a, b in us:
            inside.update(range(a, b))
        assert all(c.isspace() or c in "​﻿" or k in inside for k, c in enumerate(t))


def test_forward_backward_is_the_sum_over_paths():
    rng = random.Random(5)
    lengths = [1, 3, 6, 6, 2, 9]
    n = sum(lengths)
    q0, q1 = (np.array([rng.uniform(0.01, 0.99) for _ in range(n)]) for _ in range(2))
    begins, second = (np.array([rng.uniform(0.1, 10) for _ in range(n)]) for _ in range(2))
    sure = np.array([rng.choice([-1, -1, -1, 0, 1]) for _ in range(n)])
    first = np.zeros(n, bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    want = []
    for a, m in zip(np.cumsum([0, *lengths[:-1]]), lengths):
        mass, z = np.zeros(m), 0.0
        for path in range(2**m):
            e = [path >> k & 1 for k in range(m)]
            w, last = 1.0, 1
            for k, v in zip(range(a, a + m), e):
                q = q1[k] if last else q0[k]
                w *= (q * begins[k] if v else (1 - q) * (second[k] if last else 1.0)) * (sure[k] in (-1, v))
                last = v
            z += w
            mass += w * np.array(e)
        want += (mass / z).tolist()
    assert forward_backward(q0, q1, begins, second, sure, first) == pytest.approx(want)


def test_spark_gives_offsets_in_the_whole_text(spark, archive):
    text = "H: x\n\n😀 One two. Three four!\n-- \nme"
    a, b = text.index("😀"), text.index("\n-- ")
    rows = [(1, text, a, b), (2, None, 0, 5), (3, "", 0, 0), (4, " \n ", 0, 3), (5, "No range given.", None, None), (6, "Cut. Short", 0, 99), (7, "abc", 3, 1), (8, "So. " * 40_000, 0, 160_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_start long, own_end long").selectExpr("*", "1 as start", "'k' as kind")
    learn = spark.read.parquet(SF).selectExpr("doc_id + 100 as doc_id", "text", "own_start", "own_end")  # the model is of all the texts
    got = {}
    for r in sentence_units(df.unionByName(learn, allowMissingColumns=True)).filter("doc_id < 100").collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert [text[x:y] for x, y in sorted(got[1])] == ["😀 One two.", "Three four!"]
    assert got[5] == [(0, 15)] and sorted(got[6])[-1][1] == 10 and set(got) == {1, 5, 6, 8}
    assert sentence_units(df.limit(0)).count() == 0
