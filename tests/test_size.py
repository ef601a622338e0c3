"""Steps whose work or rows must not grow faster than their input."""

import time

import numpy as np

from lexweave.operators import lexical, models


def test_training_takes_little_time_a_token():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 500, 400) for _ in range(100)]
    began = time.process_time()
    lexical.train_sgns(docs, np.full(500, 80.0), dim=16)
    assert time.process_time() - began < 6


def test_rows_of_a_start_depend_on_the_word_alone():
    rows = lexical.start_rows(np.arange(50_000), 16, 1)
    assert (lexical.start_rows(np.array([7, 40_000]), 16, 1) == rows[[7, 40_000]]).all()
    assert abs(rows.mean()) < 1e-3 and abs(rows.std() - 0.25) < 1e-3
