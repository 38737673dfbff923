"""Pages labelled by hand: what is main text stands in elements with the attribute ``MARK``. ``[n]`` stands for n words and a full stop, ``{n}`` for n words."""

from __future__ import annotations

import re

MARK = "data-main"

_LAYOUTS = (
    # a news page
    '<header class="site-header" role="banner"><a class="logo" href="/">{2}</a><form class="search" role="search"><label>{1}</label></form></header>'
    '<nav class="main-menu" role="navigation"><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul></nav>'
    '<div class="cookie-notice" id="gdpr-consent"><p>[14]</p><a>{1}</a></div><div class="ad advert banner"><p>[8]</p></div>'
    '<main id="content"><article class="post article" data-main><header class="entry-header"><h1 class="title headline">{7}</h1></header><div class="entry-content body"><p>[40]</p><p>[30] <a>{3}</a> [22]</p>'
    '<h2>{3}</h2><p>[70]</p><p>[2]</p><ul><li>[6]</li><li>[9]</li></ul><blockquote><p>[20]</p></blockquote><p>[33]</p></div></article>'
    '<section class="comments reader-comments" id="comments"><h3>{2}</h3><div class="comment"><span class="author">{2}</span><p>[18]</p></div><div class="comment reply"><p>[25]</p></div></section></main>'
    '<aside class="sidebar" role="complementary"><h3>{2}</h3><ul><li><a>{5}</a></li><li><a>{6}</a></li></ul></aside>'
    '<footer class="site-footer" role="contentinfo"><p>[9]</p><ul><li><a>{1}</a></li><li><a>{2}</a></li></ul></footer>',
    # a blog of plain divisions
    '<div id="wrapper"><div id="header"><div class="logo">{3}</div><div class="tagline">{5}</div></div><div id="nav" class="navbar menu"><a>{1}</a> | <a>{1}</a> | <a>{2}</a> | <a>{1}</a></div>'
    '<div id="main"><div class="post" data-main><h1 class="post-title">{6}</h1><div class="post-body story text"><p>{12} <a>{4}</a> {9} <a>{1}</a> [18]</p><p>[44]</p><p>[3] <a>{2}</a></p><h3>{4}</h3><p>[80]</p><pre>{12}</pre><p>[25]</p></div></div>'
    '<div class="share social buttons"><a>{1}</a><a>{1}</a><a>{2}</a></div><div class="related recommended"><h4>{2}</h4><ul><li><a>{6}</a></li><li><a>{7}</a></li></ul></div>'
    '<div id="disqus_thread" class="responses discussion"><ol class="commentlist"><li class="comment"><p>[30]</p></li><li class="comment"><p>[12]</p></li><li class="comment"><p>[22]</p></li></ol><form id="respond" class="comment-form"><label>{2}</label><p>[7]</p></form></div></div>'
    '<div id="sidebar" class="widget"><h3>{1}</h3><div class="newsletter subscribe signup"><p>[11]</p></div><div class="widget archive tags"><a>{1}</a> <a>{1}</a></div></div>'
    '<div id="footer" class="copyright legal"><p>[8]</p></div></div>',
    # headings and paragraphs without any name
    '<div><a>{1}</a><a>{1}</a><a>{2}</a><a>{1}</a></div><div data-main><h1>{6}</h1><p>[35]</p><p>{8} <a>{2}</a> [5]</p><p>[1]</p><h2>{3}</h2><p>[65]</p><p>[4]</p><p>[28]</p></div><div><a>{2}</a><a>{2}</a> {3}</div>',
    # a page of nothing but text
    "<section data-main><h1>{5}</h1><p>[30]</p><p>[45]</p><p>[2]</p><p>[22]</p><p>[60]</p></section>",
    "<body data-main>[12]</body>",
    "<body data-main>{5}</body>",
    # a manual with a table of contents
    '<div class="topbar toolbar"><a>{2}</a><span>{1}</span><div class="login account"><a>{1}</a></div></div><div class="breadcrumb breadcrumbs"><a>{1}</a> / <a>{1}</a> / <span>{2}</span></div>'
    '<div class="toc sidenav contents-menu"><ul><li><a>{2}</a></li><li><a>{3}</a></li><li><a>{2}</a></li></ul></div>'
    '<div class="document content" role="main" data-main><h1>{3}</h1><p>[25]</p><h2>{2}</h2><p>[40]</p><dl><dt>{1}</dt><dd>[12]</dd><dt>{1}</dt><dd>[9]</dd></dl><table><tr><th>{1}</th><th>{1}</th></tr><tr><td>{2}</td><td>{5}</td></tr></table><p>[38]</p><ol><li>[14]</li><li>[11]</li></ol></div>'
    '<div class="pagination pager"><a>{1}</a><a>{1}</a></div><div class="footer bottom"><span>{4}</span></div>',
    # an article cut by an advert, a notice and a form
    '<div class="page container"><div class="masthead top-nav"><a>{2}</a><ul><li><a>{1}</a></li><li><a>{1}</a></li></ul></div><div class="alert notice warning" role="alert"><p>[16]</p></div>'
    '<article class="story article-body" data-main><h1 class="headline">{8}</h1><p class="lead intro">[24]</p><p>[60]</p></article><div class="ads sponsored adsbygoogle promo"><p>[13]</p><a>{3}</a></div>'
    '<div class="paywall subscription popup modal" role="dialog"><p>[15]</p></div><form class="contact newsletter-form"><p>[9]</p><label>{1}</label><fieldset><legend>{2}</legend></fieldset></form>'
    '<div class="disclaimer terms privacy"><p>[30]</p></div><div class="author-bio byline meta"><p>[12]</p></div><div class="teaser cards more trending popular latest"><div class="card"><a>{6}</a></div><div class="card"><a>{7}</a></div></div></div>',
    # paragraphs straight in the body behind a banner
    '<div class="promotion offer deals"><p>[10]</p></div><div class="skip hidden-link"><a>{3}</a></div><div data-main><h2>{5}</h2><p>[48]</p><p>[52]</p><p>[7]</p><p>[31]</p></div><div class="feedback reviews rating"><p>[19]</p><p>[14]</p></div><div class="address contact-info"><p>{6}</p></div>',
    # reader comments longer than the article
    '<div class="entry hentry article-text" data-main><h1 class="entry-title">{5}</h1><p>[26]</p><p>[18]</p></div><section class="user-comments replies"><div class="comment-body"><p>[60]</p></div><div class="comment-body"><p>[75]</p></div><div class="reply"><p>[40]</p></div></section>',
    # answers of readers in lists
    '<div class="text story" data-main><h1>{4}</h1><p>[30]</p><p>{20} <a>{5}</a> [3]</p></div><div class="user-feedback"><ul class="comments replies thread"><li class="user-comment"><p>[45]</p></li><li class="user-reply"><p>[50]</p></li></ul></div>',
    # menus of long names and footers of sentences
    '<div class="navigation mega-menu dropdown"><ul><li><a>{4}</a></li><li><a>{5}</a></li><li><a>{4}</a></li></ul></div><div class="article content-body" data-main><h1>{9}</h1><p>[33]</p><p>[29]</p><h2>{4}</h2><p>[41]</p><p>[3]</p></div>'
    '<div class="footer-text imprint"><p>[22]</p></div><div class="cookies consent-bar gdpr"><p>[20]</p></div><div class="notification announcement"><p>[12]</p></div><div class="site-info credits"><p>[7]</p></div>',
    # an archive page in tables
    '<table class="layout"><tr><td class="leftcol menu links"><a>{1}</a><br><a>{2}</a><br><a>{1}</a></td><td class="maincol" data-main><h1>{4}</h1><p>[42]</p><p>[37]</p><p>[58]</p></td><td class="rightcol advertisement"><a>{4}</a><p>[6]</p></td></tr></table>',
)


def _filled(layout: str) -> str:
    """The layout with words in place of their numbers."""
    words = re.sub(r"\[(\d+)\]", lambda m: " ".join(["word"] * int(m.group(1))) + ".", layout)
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m.group(1))), words)


LABELLED = tuple(_filled(layout) for layout in _LAYOUTS)
