"""Bank accounts next to other words, and context words before an earlier match."""

from twinside.llm import pii

DE, GB, NO = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"


def test_accounts_before_words_and_shared_context(spark):
    texts = [f"{DE} Please pay", f"to {DE} BIC COBADEFFXXX", f"{DE} 2024", f"{DE} {GB} X", f"\U0001f600 NO12 DE89 3704 0044 0532 0130 00 A {NO}", f"{DE}0", "SSN 123-45-6789, 234-56-7891", "x 123-45-6789, 234-56-7891"]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    iban = lambda k, *found: ",".join(f"iban:{texts[k].index(f)}:{texts[k].index(f) + len(f)}" for f in found)
    spans = {k: ",".join(x for x in v.split(",") if x.startswith(("iban", "ssn"))) for k, v in got.items()}
    assert spans == {0: iban(0, DE), 1: iban(1, DE), 2: iban(2, DE), 3: iban(3, DE, GB), 4: iban(4, "DE89 3704 0044 0532 0130 00", NO), 5: "", 6: "ssn:4:15,ssn:17:28", 7: ""}
