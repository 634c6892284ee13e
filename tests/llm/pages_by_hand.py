"""Pages written by hand, which the extraction's tree has not seen."""

_LONG = "The harbour board met in the old hall on Tuesday, and after a long talk about the price of coal and the state of the quay it was agreed to wait. "
#: Page by page: whether a fragment's blocks belong to the article, and the fragment.
PAGES: tuple[tuple[tuple[bool, str], ...], ...] = (
    (
        (False, "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"),
        (False, '<div class="ad">Buy the new phone today and save money.</div>'),
        (True, "<article><h1>River floods the old town</h1>"),
        (True, "<p>The river rose above its banks on Monday night and reached the market square before dawn.</p>"),
        (True, "<p>Short one.</p>"),
        (True, '<p>Officials said that <a href="/r">the report</a> would follow within the week, and that the bridges stay closed.</p></article>'),
        (False, "<footer>&copy; 2020 Example Press. All rights reserved.</footer>"),
    ),
    (
        (False, '<header><a href="/">The Daily Example</a><p>Your paper since 1900</p></header>'),
        (False, '<div class="cookie-notice">We use cookies to give you the best experience on this site. <button>Accept</button></div>'),
        (True, "<main><h1>How to bake bread</h1><p>Mix the flour with water and salt, then let the dough rest for an hour in a warm place.</p>"),
        (True, "<ul><li>Two cups of flour</li><li>One cup of water</li></ul><p>Bake until the crust is brown.</p></main>"),
        (False, '<aside class="sidebar"><h3>Popular</h3><p>Ten places that you should see this year before they close.</p></aside>'),
        (False, '<form><label>Name</label><p>Write to us, we answer every letter that we get within three days.</p></form>'),
    ),
    (
        (False, '<div id="menu"><a href=/a>Start</a> <a href=/b>Shop</a> <a href=/c>Contact</a></div>'),
        (True, "<div><h2>A quiet year for the harbour</h2><p>Fewer ships came than in any year since the war, the harbour master wrote in the yearly report.</p>"),
        (True, "<p>He expects that trade will grow again once the new quay is open and the dredging is done.</p><p>The council agrees with him on this.</p></div>"),
        (False, '<div class="comments"><h3>Comments</h3><p>I have lived there for forty years and I can say that this is true.</p><p>Nonsense, as always.</p></div>'),
        (False, '<div class="related"><a href=/1>More on ships</a> <a href=/2>More on trade</a></div>'),
        (False, '<div class="footer">Imprint and contact</div>'),
    ),
    (
        (False, "<div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a> <a href=/4>Four</a></div>"),
        (False, "<div>Log in</div>"),
        (True, "<div><p>The committee met three times in spring and found no fault in the way the money had been spent.</p></div>"),
        (True, "<div><p>Two members did not sign the paper, and neither of them has said in public why not.</p></div>"),
        (False, "<div><a href=/x>Read the next story</a></div>"),
        (False, "<div>Copyright Example</div>"),
    ),
    (
        (False, '<section class="newsletter"><p>Subscribe to our newsletter and get all the news every morning in your mail box.</p></section>'),
        (True, "<article><header><h1>Under the ice</h1></header><p>Divers have found the wreck.</p><blockquote>We did not believe it at first.</blockquote>"),
        (False, '<div class="advert">Holiday flats by the sea, book now and pay later.</div>'),
        (True, "<p>The hull is whole and the cargo is still on board, the divers told the paper after they came back.</p><pre>depth 40 m</pre>"),
        (False, '<div class="share">Share this story with your friends today.</div><form><p>Sign up here for free.</p></form><aside><p>See also the story of the other wreck near the cape.</p></aside>'),
        (False, '<section id="comments"><p>Great find, I hope that they will bring it up soon.</p></section></article>'),
        (False, "<footer><p>This site is run by volunteers who love the sea and its many stories.</p></footer>"),
    ),
    (
        (False, '<div role="banner">Welcome to the site</div>'),
        (True, "<article><h2>Notes</h2><p>One.</p><p>Yes</p><table><tr><td>Depth</td><td>40</td></tr></table><ol><li><a href=/y>A linked item of a list</a></li></ol><p><a href=/z>A paragraph that is one link.</a></p></article>"),
        (False, "<nav><p>Back to the first page of this site where all the stories are listed by date.</p></nav>"),
        (False, '<div class="notice">This site will be closed for repairs on Sunday from two to four.</div>'),
    ),
    (
        (False, "<header><h1>Example Weekly</h1><p>All the news of the week in one place, every Friday at noon.</p></header>"),
        (True, "<div><h1>Rain at last</h1></div><div>After ninety dry days it rained in the hills, and the farmers went out to stand in it.</div>"),
        (True, "<div>It may not be enough to save the wheat, but the pastures are green again and the wells are filling up.</div>"),
        (False, "<div><a href=/q>About</a> <a href=/w>Terms</a></div>"),
    ),
    (
        (False, f"<nav><p>{_LONG}</p></nav><header><p>{_LONG}</p></header><div class='banner'>{_LONG}</div><div id='cookie-consent'><p>{_LONG}</p></div>"),
        (True, f"<div><p>{_LONG}</p><p>{_LONG}{_LONG}</p></div>"),
        (False, f"<div class='ads'>{_LONG}{_LONG}</div><aside><p>{_LONG}</p></aside>"),
        (True, f"<section><p>{_LONG}</p></section>"),
        (False, f"<form><p>{_LONG}</p></form><div class='comment-list'><p>{_LONG}</p><p>{_LONG}{_LONG}</p></div><footer><p>{_LONG}</p></footer>"),
    ),
    (
        (False, f"<div class='ad'>{_LONG}</div>"),
        (True, f"<article><h1>Coal</h1><p>{_LONG}</p><p>{_LONG}{_LONG}</p><p>Wait.</p>"),
        (False, f"<div class='promo'>{_LONG}</div><nav><p>{_LONG}</p></nav>"),
        (True, f"<p>{_LONG}</p></article>"),
        (False, f"<footer>{_LONG}{_LONG}</footer><div class='notice'>{_LONG}</div>"),
    ),
    (
        (False, "<nav><a href=/>Home</a></nav>"),
        (True, "<article><h1>Coal</h1><h2>Old</h2><p>Yes.</p>"),
        (False, "<nav><a href=/1>Back</a> <a href=/2>On</a></nav>"),
        (True, "<p>No.</p><p>End</p></article>"),
        (False, "<div><a href=/p>Imprint</a></div><div>Print</div>"),
    ),
    (
        (False, f"<footer>{_LONG}</footer><footer><p>{_LONG}</p></footer><aside>{_LONG}</aside><div class='sidebar'>{_LONG}</div><div class='footer'>{_LONG}</div><div class='related'>{_LONG}</div>"),
        (True, f"<p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p>"),
    ),
)
