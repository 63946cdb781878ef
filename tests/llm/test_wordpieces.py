from conftest_llm import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from facetry.llm import wordpieces
from facetry.llm.tokenids import default_tokenizer

LETTERS = st.text("abc", min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.sets(LETTERS, max_size=12), st.sets(LETTERS, max_size=12), st.lists(st.text("abc", min_size=1, max_size=14), max_size=8))
def test_automaton_against_word_pieces(first, inside, words):
    entries = sorted(first | {f"##{p}" for p in inside})
    model = WordPiece({p: i for i, p in enumerate([*entries, "[UNK]"])}, unk_token="[UNK]", max_input_chars_per_word=100)
    automaton = wordpieces.build(entries, "##")
    for word in words:
        pieces = [t.value for t in model.tokenize(word)]
        assert automaton.count(word) == (wordpieces.NONE if pieces == ["[UNK]"] else len(pieces))


def test_counts(spark, odd, none):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    entries = wordpieces.vocabulary_of(default_tokenizer())
    model = WordPiece({p: i for i, p in enumerate([*entries, "[UNK]"])}, unk_token="[UNK]", continuing_subword_prefix="", max_input_chars_per_word=10**6)
    got = sorted(map(tuple, wordpieces.count_tokens(odd, default_tokenizer()).collect()), key=repr)
    want = []
    for r in odd_rows():
        words = [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(r[1] or ""))]
        want.append((r[0], len(words), sum(len(model.tokenize(w)) for w in words), 0))
    assert got == sorted(want, key=repr)
    assert wordpieces.count_tokens(none, default_tokenizer()).count() == 0
