"""Chooses the settings of the toxicity fit: five folds over the training rows of a table (crc32 of doc_id mod 3 is not 1); held-out rows are never read.

    python tests/llm/cross_validate_toxicity.py /root/testdata/sf0.1

Prints, for each setting, toxic texts caught and false alarms at 0.7, and the mean logistic loss.
"""

import itertools
import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from chunkyard.llm import toxicity as t  # noqa: E402

STEMS = {"words only": (), "stems 4 to 8": (4, 5, 6, 7, 8), "stems 5 to 8": (5, 6, 7, 8)}


def main(folder: str) -> None:
    con = duckdb.connect()
    pairs = con.execute(f"SELECT d.doc_id, text, toxic FROM '{folder}/documents.parquet' d JOIN '{folder}/labels.parquet' l USING (doc_id) WHERE toxic IS NOT NULL ORDER BY 1").fetchall()
    rows = [(zlib.crc32(f"fold {i}".encode()) % 5, t.words_of(text), toxic) for i, text, toxic in pairs if zlib.crc32(str(i).encode()) % 3 != 1]
    sketches = [t.sketch(w) for _, w, _ in rows]
    print(f"{len(rows)} training rows, {sum(y for *_, y in rows)} toxic")
    for (name, stems), most in itertools.product(STEMS.items(), (1, 3)):
        if not stems and most > 1:
            continue
        t.STEMS, t.MOST_WORDS = stems, most
        features = [t.features_of(w) for _, w, _ in rows]
        for strict, decay in itertools.product((1.0, 1.5, 2.0), (1e-5, 1e-3)):
            caught = alarms = loss = 0
            for fold in range(5):
                train = [i for i, r in enumerate(rows) if r[0] != fold]
                positive = [i for i in train if rows[i][2]]
                prior = t.smoothed(len(positive), len(train))
                positive = [positive[k] for k in t.different([sketches[i] for i in positive])]
                in_pos, in_all = (Counter(f for i in ids for f in features[i]) for ids in (positive, train))
                names = t.telling({f: (n, in_all[f]) for f, n in in_pos.items() if n >= t.LEAST_POSITIVE}, len(positive), len(train), strict)
                own = set(names)
                has = lambda ids: [[f for f in features[i] if f in own] for i in ids]
                model = t.ToxicityModel.fit(has(positive), has(train), names, prior, decay)
                for (f, _, y), x in zip(rows, features):
                    if f == fold:
                        z = model.offset + sum(model.weights.get(name, 0.0) for name in x)
                        s = 1 / (1 + math.exp(-min(max(z, -30), 30)))
                        caught += bool(y and s >= 0.7)
                        alarms += bool(not y and s >= 0.7)
                        loss -= math.log(max(1e-12, s if y else 1 - s))
            print(f"{name}, words a stem up to {most}, strict {strict}, decay {decay}: caught {caught}, false alarms {alarms}, loss {loss / len(rows):.4f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
