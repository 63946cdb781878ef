"""

    python tests/one_process.py /root/testdata/sf0.1
"""

from __future__ import annotations

import os
import re
import sys
import time

import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from facetry.operators.encode import HashingEncoder  # noqa: E402
from facetry.operators.network import Network, network_shape  # noqa: E402


def main() -> None:
    folder = sys.argv[1]
    read = lambda name: pd.read_parquet(f"{folder}/{name}.parquet")

    def timed(name, fn):
        start = time.perf_counter()
        out = fn()
        print(f"{name} {time.perf_counter() - start:.3f}", flush=True)
        return out

    def clean():
        df = read("documents").merge(read("labels"), on="doc_id", how="left")
        df = df.dropna(subset=["text", "quality", "toxic"]).drop_duplicates("text")
        return df.assign(id=[f"W{i + 1}" for i in range(len(df))])

    def items():
        return read("documents")[["doc_id", "lang", "source"]].merge(read("embeddings"), left_on="doc_id", right_on="vec_id")

    def negatives():
        df, rng = items(), np.random.default_rng(42)
        lang, label = df["lang"].to_numpy(), df["label"].to_numpy()
        pools = {k: np.flatnonzero((lang != k[0]) & (label != k[1])) for k in set(zip(lang, label))}
        return [rng.choice(pools[k], 9, replace=len(pools[k]) < 9) for k in zip(lang, label)]

    def matrix():
        df = items()
        return df, np.stack(df["embedding"].to_numpy()).astype(np.float64)

    def residuals():
        _, y = matrix()
        return y - y[:, :2] @ np.linalg.lstsq(y[:, :2], y, rcond=None)[0]

    def ridge():
        df, y = matrix()
        d = np.hstack([pd.get_dummies(df[c]).to_numpy(float) for c in ("lang", "source")])
        dc, yc = d - d.mean(0), y - y.mean(0)
        r = yc - dc @ np.linalg.solve(dc.T @ dc + np.eye(d.shape[1]), dc.T @ yc)
        u, s, _ = np.linalg.svd(r, full_matrices=False)
        return u[:, :5] * s[:5]

    def network():
        df, y = matrix()
        net = Network.initial(network_shape({"lang": 4, "label": 10}, 64, projection_units=32, embedding_units_per_attribute=4))
        return net.representations(y)

    def lexicon():
        split = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
        by_term: dict[str, set] = {}
        for r in read("benchmark").itertuples():
            for w in split(r.text):
                by_term.setdefault(w, set()).add(r.item_id)
        scores = []
        for text in read("documents")["text"]:
            words, own = split(text), {}
            for w in words:
                for c in by_term.get(w, ()):
                    own[c] = own.get(c, 0) + 1 / len(words)
            scores.append(own)
        return scores

    def hashed():
        texts = read("documents")["text"].drop_duplicates()
        return HashingEncoder()([t.replace("\n", " ").strip() or " " for t in texts])

    for name, fn in [("clean_items", clean), ("sample_negatives", negatives), ("projection_residuals", residuals),
                     ("ridge_two_attributes", ridge), ("network_representations", network), ("lexicon_scores", lexicon),
                     ("hash_vectors", hashed)]:
        timed(name, fn)


if __name__ == "__main__":
    main()
