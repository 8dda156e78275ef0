from txrisk.llm import pii


def test_national_and_grouped_numbers_from_international_seeds(spark):
    rows = [(i, f"text{i} please call +1 (017) 555-77{i:02d} today") for i in range(40)]
    found = {100: "555-7713", 101: "0171-5550199", 102: "0171 555 0199", 103: "(030) 123 45", 104: "5577", 105: "AB12-9x"}
    rows += [(i, f"please call {n} today") for i, n in found.items()] + [(200, "we saw 0171 555 0199 birds in 1999, 2000 and room 12")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert {i: got[i].spans for i in found} == {i: f"phone:12:{12 + len(n)}" for i, n in found.items()}
    assert got[200].spans == "" and all(got[i].n_phone == 1 and got[i].n_learned == 0 for i in range(40))
    clean = {r.doc_id: r.text for r in pii.without_personal_data(docs).collect()}
    assert all(clean[i] == "please call <PHONE> today" for i in found)


def test_groups_of_numbers_are_one_candidate():
    def possible(text):
        return [text[s:e] for s, e in pii._possible(text, [(s, e) for _, s, e in pii.base_spans(text)])]
    assert possible("tel 0171 555 0199, or (030) 123 45.") == ["0171 555 0199", "(030) 123 45"]
    assert possible("ip 10.0.0.1 0171 555") == ["0171 555"] and possible("in 1999, 2000\n2001") == ["1999", "2000", "2001"]
    assert possible(" ".join(["1234"] * 9)) == ["1234"] * 9
