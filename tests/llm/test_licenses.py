import pytest
from brute import words

from trajloom.llm import licenses
from trajloom.llm.queries import QUERIES


def base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert found == sorted(((i, *base(t)) for i, t in texts), key=repr)
    for r in rows:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    check(QUERIES["op3_license_scan"](spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def test_odd_rows(spark, folder, odd_documents, empty_documents):
    rows = QUERIES["op3_license_scan"](spark, folder(documents=odd_documents)).collect()
    check(rows, odd_documents.select("doc_id", "text").collect())
    (notice,) = [r for r in rows if r.doc_id == 7]
    assert notice.labels == "apache,apache-2.0-notice,mit" and notice.score == pytest.approx(8 / 10)
    assert QUERIES["op3_license_scan"](spark, folder(documents=empty_documents)).collect() == []


def labels(text, templates):
    (row,) = licenses.Scanner(templates, {}).scan([text.encode()])
    return row[5], row[6]


def test_regions_of_templates():
    t = {"x": "start [maybe [really] so] middle {1:2} end"}
    for text, score in (
        ("Start middle A end", 1), ("start maybe so middle a b END", 1), ("start maybe really so middle a end", 1),
        ("start middle end", 0), ("start maybe middle a end", 0), ("start middle a b c end", 0), ("start so middle a end", 0),
        ("zero start middle a end", 0.8), ("start start middle a end", 0.8),
    ):
        assert labels(text, t) == ("x" if score else "", score), text


def test_all_matches_and_text_borders():
    t = {"short": "the license", "long": "the license version {1:1}"}
    assert labels("the license version 3", t) == ("long,short", 1)
    assert labels("the license version", t) == ("short", 2 / 3)
    rows = licenses.Scanner(t, licenses.BASE).scan([b"mit", b"license", b"the", b"license"])
    assert [r[1] for r in rows] == [0, 0, 0, 0] and {r[5] for r in rows} == {""}


def test_every_template_matches_itself():
    for label, text in licenses.TEMPLATES.items():
        import re

        plain = re.sub(r"\{(\d+):\d+\}", lambda m: "zz " * int(m[1]), re.sub(r"[\[\]]", " ", text))
        assert label in labels(plain, licenses.TEMPLATES)[0].split(","), label


def test_bad_templates():
    with pytest.raises(ValueError):
        licenses.Scanner({"x": "a [b"}, {})
    with pytest.raises(ValueError):
        licenses.Scanner({"x": "{0:2} a"}, {})


def test_templates_inside_other_matches():
    header = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
    compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
    on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
    the specific language governing permissions and limitations under the License."""
    assert labels(header, licenses.TEMPLATES) == ("apache-2.0-header,apache-2.0-notice", 1)
    found, score = labels(f"{header} trailing words", licenses.TEMPLATES)
    assert score == pytest.approx(1 - 2 / len(words(f"{header} trailing words")))
    mit = licenses.TEMPLATES["mit-text"].split("[copyright {0:20}] ")[1].replace("{1:8}", "the authors").replace("[", "").replace("]", "")
    assert labels(f"Copyright Some One. All rights reserved. {mit}", licenses.TEMPLATES) == ("mit-text,reserved-notice", 1)


def test_labels_against_every_accepting_state():
    """Templates of the query that end on the way of a longer match are found all the same."""
    scanner = licenses.Scanner(licenses.TEMPLATES, {})
    seen, todo, lost = set(), [(scanner.start, frozenset())], set()
    final = scanner.automaton.final
    while todo:
        states, on_the_way = todo.pop()
        for word in {0, *(w for s in states for w in scanner.steps.get(s, ()))}:
            after = scanner.step(states, word)
            ends = frozenset(final[s] for s in after if s in final)
            if ends:
                lost |= {(a, b) for a in on_the_way - ends for b in ends}
            if after and (after, on_the_way | ends) not in seen:
                seen.add((after, on_the_way | ends))
                todo.append((after, on_the_way | ends))
    # Its wording "all rights reserved" is matched from its own first word.
    assert lost <= {("reserved-notice", "mit-text")}
