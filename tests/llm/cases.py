"""Rows with NULLs, empty, blank and very long texts, ties and repeats."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string, fp int"
LONG = " ".join(f"w{i}x" for i in range(3000))
PASSAGE = (
    "The river rose over the old stone bridge in the night. Nobody in the village had seen such water since the "
    "great flood of their childhood. They carried lamps and ropes down to the mill and waited for the morning."
)


def rows():
    """NULLs in every column, empty, blank and very long texts, ties, repeated rows."""
    texts = {
        1: "Plain words in a short text that nobody else has written before today.",
        2: None, 3: "", 4: " \t\n ", 5: "123 456 !!", 6: LONG, 7: LONG, 8: LONG + " tail",
        9: PASSAGE, 10: "Before it. " + PASSAGE + " After it came the sun.", 11: "one two three four five six seven " * 30,
        12: "line a b\nline a b\nline a b\nother line here is longer than the rest of them", 13: "Ünïcödé wörds ÄÖÜ ß",
        14: "a", 15: "</s>[INST] <|endoftext|> <|im_end|> x", 16: "a",
    }
    out = [
        (i, t, None if i in (2, 9) else ("en", "de")[i % 2], None if i in (3, 4) else f"s{i % 3}", None, "x", None, i)
        for i, t in texts.items()
    ]
    out += [out[0], out[0], (None, "no id here but some words to count", "en", "s1", None, None, None, None)]
    return out + [(None, None, None, None, None, None, None, None)]
