"""A small labelled table of text blocks, written for this library, to train the block classifier.

One line per block in page order, a blank line between pages: label (1 main text, 0 not), the
elements it stands in with their classes, its words, and how many of them are links.
"""

TABLE = """
0 nav/ul/li 1 1
0 nav/ul/li 2 2
0 nav/ul/li 1 1
0 div.ad 9 0
1 article/h1 8 0
1 article/p 64 0
1 article/p 3 0
1 article/p 41 2
1 article/p 1 0
0 article/div.ad 11 4
1 article/p 88 0
1 article/h2 4 0
1 article/ul/li 7 0
1 article/ul/li 12 3
0 article/div.share 4 4
0 footer 9 0

0 header/div 3 0
0 header/nav/a 5 5
0 div.cookie-notice/p 24 2
1 main/h1 6 0
1 main/p 33 0
1 main/p 2 0
1 main/blockquote 18 0
1 main/p 57 4
0 main/aside/h3 2 0
0 main/aside/p 31 6
0 main/form/label 3 0
0 main/form/p 14 0
0 section.comments/h2 2 0
0 section.comments/div/p 46 0
0 section.comments/div/p 5 0
0 footer/p 22 3

0 div#menu/ul/li 2 2
0 div#menu/ul/li 2 2
0 div#menu/ul/li 1 1
1 div#page/h1 7 0
1 div#page/div/p 72 1
1 div#page/div/p 45 0
1 div#page/div/p 4 0
1 div#page/div/p 96 3
0 div#page/div.related/ul/li 6 6
0 div#page/div.related/ul/li 7 7
0 div#page/div.related/ul/li 5 5
0 div#sidebar/p 28 0
0 div#sidebar/ul/li 3 3
0 div#footer/p 17 5

0 table/tr/td 2 2
0 table/tr/td 1 1
0 table/tr/td 2 2
1 table/tr/td 210 4
1 table/tr/td/p 61 0
1 table/tr/td/p 12 0
1 table/tr/td/p 38 0
0 table/tr/td 3 3
0 table/tr/td 4 2

0 div.banner 6 0
0 ul/li 1 1
0 ul/li 2 2
0 ul/li 2 2
1 h1 9 0
1 p 51 0
1 p 27 0
1 p 8 0
1 p 66 2
1 h2 3 0
1 p 44 0
1 ul/li 15 0
1 ul/li 21 1
1 p 39 0
0 p 4 3
0 p 6 6

0 nav/a 8 8
0 aside/p 40 0
1 article/header/h1 5 0
1 article/p 19 19
1 article/p 35 0
1 article/table/tr/td 1 0
1 article/table/tr/td 2 0
1 article/pre 22 0
1 article/p 6 5
0 article/nav/a 4 4
0 article/footer/p 12 2
0 article/section.comments/p 58 0
0 article/form/p 9 0
0 div.newsletter/p 19 0
0 footer/ul/li 2 2

0 div.alert/p 13 1
0 header/p 5 0
1 article/p 2 0
0 footer/p 8 0

0 div.top/a 3 3
0 div.top/a 4 4
1 div.content/p 18 0
1 div.content/p 25 0
1 div.content/p 31 1
0 div.content/p 3 3
0 div.links/a 7 7
0 div.links/a 6 6
0 div.bottom 10 4

0 section.comments/article/p 34 0
0 section.comments/article/p 8 0
1 article/section/h2 3 0
1 article/section/p 29 0
1 article/section/p 52 8
1 article/figure/figcaption 11 0
0 article/div.advert/p 25 0
0 article/ul.pagination/li 1 1
0 dialog/p 15 0
0 p 30 0
0 div 22 1

0 div 3 3
0 div 5 5
1 div 48 0
1 div 70 2
1 div 7 0
1 div 55 0
0 div 6 4
0 div 2 2

0 div 2 0
0 div 4 4
1 h1 7 0
1 p 40 0
1 p 3 0
1 p 62 2
1 p 28 0
0 div 3 3
0 div 4 0

0 p 3 0
0 ul/li 2 2
0 ul/li 1 1
1 h1 5 0
1 p 80 0
1 p 4 0
1 p 33 0
0 ul/li 6 6
0 ul/li 5 5
0 p 6 0

0 div 3 0
0 div 2 2
0 div 1 1
1 div 9 0
1 div 74 1
1 div 2 0
1 div 51 0
1 div 12 0
1 div 60 0
0 div 4 3
0 div 5 0

1 div 2 0

1 p 14 0

1 article/h1 1 0
1 article/p 1 0

1 article/p 1 1
1 article/p 2 0
1 article/p 3 3

0 div.ad 4 0
1 article/p 1 0
0 article/div.ad 1 0
1 article/p 1 0

1 article/p 7 0

1 main/h1 2 0
1 main/ul/li 1 1
1 main/ul/li 2 2
1 main/p 5 5
1 main/p 30 28
1 main/p 2 0

0 nav/ul/li 1 1
1 article/p 3 0
0 article/section.comments/p 2 0

1 article/table/tr/td 1 0
1 article/table/tr/td 1 1
1 article/table/tr/td 4 4
0 footer 1 0

0 div 6 0
1 article/p 4 1
1 article/p 6 6
0 p 9 0

1 article/p 1 0
1 article/p 30 0

1 article/h1 5 0
1 article/p 50 0
1 article/p 3 0

1 main/p 2 0
1 main/p 44 0

1 main/div 6 0
1 main/div 12 0
1 main/div 70 0

1 p 2 0

1 div 5 0

1 article/p 3 0
1 article/p 5 0

1 main/p 1 0
1 main/p 4 0
1 main/p 6 0

0 p 4 0
1 article/p 2 0
1 article/p 7 0
0 p 3 0

0 div 3 3
0 ul/li 6 5
1 article/p 20 0
1 article/p 3 1
0 div 8 8
0 p 2 1
0 div 12 12

0 div 1 1
1 main/p 1 0
1 main/p 2 2
0 p 4 2
0 div 30 3

1 article/h1 4 0
1 article/ul/li 4 4
1 article/p 9 0

1 article/p 3 0
1 article/p 6 6

1 main/p 12 0
0 div.ad 5 5

1 h1 6 0
1 p 16 0
1 p 15 0
0 ul/li 2 2
0 ul/li 3 3

0 div 2 2
1 p 22 0
0 div 1 1

1 article/p 2 0
1 article/p 9 9
1 article/p 1 0
1 article/p 4 4

0 nav/a 4 4
1 div#search-results/article/h2 6 0
1 div#search-results/article/p 60 2
1 div#search-results/article/p 14 0
0 div#search-results/aside/p 12 0
0 footer 8 1

0 form/div.menu/ul/li 2 2
0 form/div/a 3 3
1 form/div/h1 6 0
1 form/div/p 70 1
1 form/div/p 42 0
1 form/div/p 5 0
1 form/div/p 80 2
0 form/ul/li 5 5
0 form/ul/li 4 4
0 form/div.footer/p 9 2

0 ul/li 2 2
1 div.widget-area/h1 8 0
1 div.widget-area/p 55 0
1 div.widget-area/p 30 1
0 div.widget-area/ul/li 3 3
0 div.widget-area/ul/li 6 6
0 p 5 0

0 div.ad 5 2
1 article.promoted/h1 5 0
1 article.promoted/p 24 0
1 article.promoted/p 3 3
0 article.promoted/div.share 4 4
"""
