"""Identifiers of shapes that no base pattern knows, found by the words around them."""

from docketry.llm import personal_data as p


def found(spark, rows):
    return {r.doc_id: r.spans for r in p.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_runs_of_digit_groups(spark):
    rows = [(i, f"please call me +1 (2{i:02d}) 555-01{i:02d} soon") for i in range(40)]
    rows += [(50, "please call me (017) 555-7713 soon"), (51, "please call me 555 123 987 soon"), (52, "sizes are 555 123 988 pieces"),
             (53, "on 3 May please call me 555 12 soon")]
    out = found(spark, rows)
    assert out[50] == "phone:15:29" and out[51] == "phone:15:26" and out[52] == "" and out[53] == "phone:24:30"
    masked = {r.doc_id: r.text for r in p.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[50] == masked[51] == "please call me <PHONE> soon"


def test_addresses_and_cards(spark):
    rows = [(i, f"the host at 10.0.{i}.7 answered") for i in range(40)] + [(50, "the host at 10.0.0.300 answered"), (51, "the host at fe80::1 answered")]
    cards = []
    for i in range(40):
        body = f"45391488034{i:04d}"
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
        number = body + str(-total % 10)
        cards.append((100 + i, "my card number " + " ".join(number[k:k + 4] for k in range(0, 16, 4)) + " expires"))
    wrong = cards[0][1][15:33] + str((int(cards[0][1][33]) + 1) % 10)
    out = found(spark, rows + cards + [(200, f"my card number {wrong} expires")])
    assert out[50] == "ip:12:22" and out[51] == "ip:12:19" and out[200] == "card:15:34"
