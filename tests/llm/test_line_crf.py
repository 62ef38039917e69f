"""What the line CRF is fitted on."""

from genoweave.llm import line_crf


def test_fit_takes_all_lines(monkeypatch):
    good = "\n".join(f"This is line {i} of a plain text." for i in range(450))
    bad = good + "\n" + "\n".join("$$$ ### buy*** now###" for _ in range(50))
    fit, seen = line_crf._fit_chain, []
    monkeypatch.setattr(line_crf, "_fit_chain", lambda x, y, sizes, *a: seen.append(list(sizes)) or fit(x, y, sizes, *a))
    line_crf.learn([good, bad], [1, 0])
    assert seen[0] == [450, 500]
