import random

from meterloom.llm import url_lm as u


def test_bad_words_anywhere_in_the_url(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choices(["tion", "the", "ing", "re", "and", "sh", "ly"], k=3))
    bad = ["casino-win", "cheap-pills", "spam-farm"]
    urls = [f"https://{'www.' * (i % 2)}{name()}.example.{rng.choice(['net/en', 'org/fr'])}/{name()}/{i}?q={name()}" for i in range(2000)]
    urls += [f"https://{'www.' * (i % 2)}{rng.choice(bad)}.example.com/en/{rng.choice(bad)}/{i}?q={rng.choice(bad)}" for i in range(600)]
    urls += [f"https://www.{name()}.com/{rng.choice(['en', name()])}/{i}?q={name()}" for i in range(2000)]
    tests = {}
    for i in range(20):
        w, n = rng.choice(bad).replace("-", ""), name()
        for kind, make in {"domain": "https://www.{0}.com/en/{1}", "segment": "https://www.x.com/{0}/{1}", "query": "https://www.x.com/?q={0}"}.items():
            for says, word in (("block", w), ("allow", n)):
                tests[len(urls)] = (kind, i, says)
                urls.append(make.format(word, i))
    got = {r.page_id: r for r in u.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    llr = {v: got[k].llr for k, v in tests.items()}
    for kind in ("domain", "segment", "query"):
        raised = sum(llr[kind, i, "block"] > llr[kind, i, "allow"] for i in range(20))
        assert raised >= 18, (kind, raised)
