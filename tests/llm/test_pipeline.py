import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import language_id as I, quality_rules as Q

from .conftest import SF
from .test_near_dedup import brute as groups
from .test_packing import check, pieces_of
from .test_substring_dedup import brute as cut


def test_stages_against_brute_force(spark, documents, texts):
    """run() gives what the stages give one by one by brute force, each on all that its predecessor has kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "substring_dedup", "best_fit_packing"]
    net = I.fit(documents)
    raw = {i: (t or "").encode() for i, t in texts.items()}
    kept = [i for i in sorted(raw) if I.has_letters(raw[i]) and I.predict(net, [raw[i]])[1][0] >= 0.4]
    assert len(raw) - len(kept) < 40

    names, counts = list(Q.RULES), Q.count_texts([raw[i] for i in kept])
    votes = [tuple(int(p) // 3**k % 3 - 1 for k in range(len(names))) for p in counts["pattern"]]
    model = Q.fit_patterns(sorted({v: votes.count(v) for v in votes}.items()), names)
    good = []
    for k, i in enumerate(kept):
        logit = np.log(model.prior / (1 - model.prior)) + sum(model.weights(n)[v > 0] if v else 0.0 for n, v in zip(names, votes[k]))
        if logit >= 0 and counts["n_words"][k] >= 10 and 100 * counts["n_repeat_words"][k] <= 20 * counts["n_words"][k]:
            good.append(i)
    told, links = groups([(i, texts[i]) for i in good])
    assert links
    first = [i for i in good if told[i][1] == i]

    words, left = cut([(i, texts[i]) for i in first])
    tokenizer, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for i in first:
        if left[i]:
            text = texts[i] if len(left[i]) == len(words[i]) else b" ".join(left[i]).decode()
            pieces += pieces_of(i, [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 2_048)
    made = corpus_pipeline.run(spark, SF).collect()
    n = check(made, pieces, 2_048)
    assert n <= 1.02 * (-(-sum(p[3] for p in pieces) // 2_048)) + 1


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert made.columns == docs.columns
                made = corpus_pipeline.written(made, "test")
            docs = made
        assert docs.collect() == [] or {r.doc_id for r in docs.collect()} <= set(range(30)) | {None}
