from parchment.llm import html_extract as H

STORY = "<article><h1>Hello there</h1><p>The story goes on for long.</p></article>"
TEXT = "Hello there\n\nThe story goes on for long."


def text(source):
    return H.default_model().extract(H.parse(source))


def test_head_without_end_tag():
    assert text("<head><title>T</title><body>" + STORY) == TEXT
    assert text("<html><head><title>T</title><meta charset=x>" + STORY) == TEXT
    assert text("<head><title>T</title></head><body>" + STORY) == TEXT
    assert text("<head><noscript><p>no</p></noscript><title>T</title></head><body>" + STORY) == TEXT


def test_scripts_in_head_are_raw():
    assert text("<head><script>x='<head>'</script></head><body>" + STORY) == TEXT
    assert text("<head><script>x='<!--'</script><style>/* <body> */</style></head><body>" + STORY) == TEXT


def test_skipped_elements_without_end_tag():
    for tag in "noscript svg select button video object audio canvas template math datalist".split():
        assert text(f"<body><div><{tag}>gone</div>{STORY}") == TEXT, tag
        assert text(f"<body><{tag}>gone{STORY}") == TEXT, tag
        assert text(f"<body><div><{tag}>gone</div>{STORY}<div><{tag}>gone</{tag}></div>") == TEXT, tag
        assert text(f"<body><div><{tag}><div>gone</div></{tag}></div>{STORY}") == TEXT, tag
    assert text("<body><div><svg><svg></svg><text>gone</text></svg></div>" + STORY) == TEXT


def test_many_open_elements():
    assert "long text" in text("<article>" + "<svg><p>long text of words. " * 5000 + "</svg>" + "<p>long text of words.")
