"""Pages of the kinds that have lost text: open links, forms around pages, teasers on the host's path."""

from quern.llm.html_text import candidates, extract_text, host_paths, main_text

LONG = " ".join(f"Sentence {i} of the story tells what happened on that day, in plain words." for i in range(9))
OTHER = " ".join(f"Line {i} of a second part goes on about the same matter at some length." for i in range(7))


def test_an_anchor_without_an_address_is_no_link():
    assert main_text(f"<body><article><a name=top><p>{LONG}</p><p>{OTHER}</p></article>", None) == f"{LONG}\n{OTHER}"
    assert main_text(f"<body><div class=c><a name=top><p>{LONG}</p><p>{OTHER}</p></div>", None) == f"{LONG}\n{OTHER}"


def test_an_open_link_ends_with_its_element_or_at_the_next():
    assert main_text(f"<body><div class=c><p><a href=x>top</p><p>{LONG}</p><p>{OTHER}</p></div>", None) == f"top\n{LONG}\n{OTHER}"
    menu = "".join(f"<li><a href={i}>item {i}" for i in range(40))
    assert main_text(f"<body><ul class=c>{menu}</ul><div class=d><p>{LONG}</p></div>", None) == LONG
    assert main_text(f"<body><a href=x><div class=d><p>{LONG}</p></div></a><div class=e><p>{OTHER}</p></div>", None) == OTHER


def test_a_form_around_the_page_is_the_page():
    assert main_text(f"<body><form id=aspnetForm><article><p>{LONG}</p></article></form>", None) == LONG
    assert main_text(f"<body><form id=aspnetForm><div class=story><p>{LONG}</p></div><div class=sidebar>links</div></form>", None) == LONG
    assert main_text(f"<body><article><p>{LONG}</p></article><form class=x><p>Subscribe to this</p></form>", None) == LONG
    assert main_text(f"<body><aside><article><p>{OTHER[:90]}</p></article></aside><div class=d><p>{LONG}</p></div>", None) == LONG


def test_a_page_leaves_the_hosts_path_for_a_teaser():
    page = f"<body><div class=intro><p>A short teaser in here.</p></div><div class=story><p>{LONG}</p></div>"
    assert main_text(page, "body>div.intro", ["body>div.story"]) == LONG
    assert main_text(page, "body>div.intro", ["body>div.none"]) == main_text(page, "body>div.intro") == "A short teaser in here."
    assert main_text(page.replace("A short teaser in here.", OTHER), "body>div.intro", ["body>div.story"]) == OTHER


def test_paths_that_a_host_votes_for(spark):
    page = lambda intro, story: f"<body><div class=intro><p>{intro}</p></div><div class=story><p>{story}</p></div>"
    rows = [(i, "http://h.org/", page(LONG, OTHER[:250])) for i in range(4)] + [(9, "http://h.org/", page("A short teaser.", LONG)), (10, "http://h.org/", "<body><div class=x><p>" + LONG)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert [(r.box, r.others) for r in host_paths(df).collect()] == [("body>div.intro", ["body>div.story"])]
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    assert got == {**{i: LONG for i in range(4)}, 9: LONG, 10: LONG}


def test_all_paths_vote_with_their_best_container():
    page = "<body>" + "".join(f"<div class={c}><p>{LONG[: 80 * k]}</p></div>" for k, c in enumerate("abcdefg", 1))
    votes = dict(candidates(page))
    assert {f"body>div.{c}" for c in "abcdefg"} <= set(votes) and max(votes.values()) == 1000 and votes["body>div.g"] == max(v for p, v in votes.items() if p != "body")
    many = f"<body><div class=s><p>{LONG}</p></div>" + f"<div class=t><p>{OTHER[:100]}</p></div>" * 50
    votes = dict(candidates(many))
    assert votes["body>div.s"] > 4 * votes["body>div.t"]


def test_hosts_of_pages(spark):
    story = f"<body><div class=story><p>{LONG}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", story) for i in range(4)] + [(9, "http://h.org/9", f"<body><form><a name=x><div class=story><p>{OTHER}</p></div></form>"), (10, None, story), (11, "http://h.org/11", None)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {**{i: LONG for i in range(4)}, 9: OTHER, 10: LONG, 11: ""}
