"""Small tables with the hard cases of every operator."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, size long, fp long, block long, place long, url string, d long, rate double, k long"
TEXTS = [
    None, "", " \n\t ", "one", "the cat sat on the mat and the dog ran off to the sea " * 3, "the cat sat on the mat and the dog ran off to the sea " * 3,
    "Mail bob.smith@mail.example.com or +1 (547) 555-0128, card 4176065765772002, ip 42.144.35.254.", "Again bob.smith@mail.example.com! password=d9f3929e83c8655244 Mrs Anna Smith",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nReleased under the MIT License.", "日本語 の テキスト です 。 " * 12, "aaaaaaaa" * 40, "x y " * 3000, "ДОМ дом " * 30, "\x00 nul and <|endoftext|> here",
]


def hard(spark, rows=None):
    texts = TEXTS if rows is None else rows
    data = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", None, 7, True, 1, 2, 3, 4, "clash", 5, 0.5, 6) for i, t in enumerate(texts)]
    data += data[4:7]  # repeated rows
    data.append((None, "the null document has a text of its own and some words", "en", None, None, 7, True, 1, 2, 3, 4, "clash", 5, 0.5, 6))
    return spark.createDataFrame(data if rows is None else data[: len(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
