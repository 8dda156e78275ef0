import io
import random

import sentencepiece

from txrisk.llm import pieces

RNG = random.Random(3)
#: Words of few letters, so that many segmentations differ by less than 1.
WORDS = ["".join(RNG.choices("abcd", k=RNG.randint(3, 9))) for _ in range(300)]
LINES = [" ".join(RNG.choices(WORDS, k=12)) for _ in range(300)]


def test_a_unigram_model_gives_the_segmentation_of_highest_score():
    out = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(LINES), model_writer=out, model_type="unigram", vocab_size=500,
        hard_vocab_limit=False, byte_fallback=True, normalization_rule_name="identity", minloglevel=2)
    model = out.getvalue()
    sp, v = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Vocabulary(model)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    assert any(x != round(x) for x in score.values())
    texts = [" ".join("".join(RNG.choices("abcd", k=RNG.randint(3, 9))) for _ in range(20)) for _ in range(40)]
    ids, off = pieces.encode_texts(v, texts)
    for k, text in enumerate(texts):
        whole = "▁" + text.replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(whole)
        for e in range(1, len(whole) + 1):
            best[e] = max([best[s] + score[whole[s:e]] for s in range(e) if whole[s:e] in score], default=float("-inf"))
        got = sum(sp.get_score(int(i)) for i in ids[off[k]:off[k + 1]])
        assert abs(got - best[-1]) < 1e-3
