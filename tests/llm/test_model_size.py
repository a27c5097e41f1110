"""The recurrent model of op9 keeps its full output layer."""

import numpy as np
import pandas as pd

from glyphflow.llm import language_model


def test_words_up_to_rank_4095_are_symbols_of_their_own():
    counts = np.arange(6000, 0, -1)
    head = pd.DataFrame({"word": [b"\n", *(b"w%d" % i for i in range(1, 6000))], "c": counts})
    model = language_model.Model(head, int(counts.sum()), len(head))
    own = model.symbol_of[:4095]
    assert len(set(own.tolist())) == 4095 and model.rest not in own
    assert set(model.symbol_of[4095:6000].tolist()) == {model.rest}
    assert len(model.shape.starts) - 1 == 64
