import pytest

from leadwright.llm.html_extract import main_text


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("at", [0, 2, 4])
def test_one_very_long_paragraph_keeps_the_others(tag, at):
    sizes = [300] * 5
    sizes[at] = 10_000
    paragraphs = [f"{k}" + "w " * (n // 2) for k, n in enumerate(sizes)]
    html = "<html><body><nav>Menu</nav>" + "".join(f"<{tag}><p>{p}</p></{tag}>" for p in paragraphs) + "<footer>end</footer></body></html>"
    assert main_text(html) == " ".join(p.strip() for p in paragraphs)
