"""Rows written and checked by hand: the class of each text, and of each title (0 proper, 1 junk, 2 prose).

TITLES are trained on. SEGMENTS and HELD_TITLES calibrate the probabilities and are never trained on; TEST_SEGMENTS and
TEST_TITLES do neither and measure accuracy and log loss.
"""

SEGMENTS = [
    ("We rely on a single supplier for most of our glass, and a delay in its deliveries would hurt our sales in the second half of the year.", "prose"),
    ("The plaintiff seeks damages of $4.2 million. We believe that the claim has no merit and intend to defend against it, although the outcome can't be known.", "prose"),
    ("Our revenue rose 12 percent to $88.1 million in 2021, mainly because of higher prices in Europe and the purchase of two depots.", "prose"),
    ("No member of the board has any family relationship with another member, nor with an officer of the company.", "prose"),
    ("As of December 31, 2020, 412 people worked for us in nine countries. None of them is covered by a collective agreement.", "prose"),
    ("• glass and ceramics\n• wooden pallets\n• paper for labels\n• spare parts\n• fuel for trucks", "list"),
    ("(a) charter of the company\n(b) bylaws as amended\n(c) form of share certificate\n(d) lease of the Dover plant", "list"),
    ("1. Retail stores\n2. Wholesale depots\n3. Online shop\n4. Leased warehouses\n5. Repair services", "list"),
    ("- Dover, leased, offices\n- Leeds, owned, warehouse\n- Hull, leased, plant\n- York, owned, laboratory", "list"),
    ("Glass Furnaces\nRaw Materials and Supplies\nPatents of the Group\nSeasonal Business\nEnvironmental Matters", "list"),
    ("(In thousands)\n2021\t2020\nNet sales\t88,120\t79,004\nCost of sales\t(51,902)\t(47,118)\nGross profit\t36,218\t31,886", "table"),
    ("Cash ............ 12,004\nReceivables ............ 33,871\nInventories ............ 20,115\nTotal assets ............ 65,990", "table"),
    ("Net sales\n88,120\n79,004\nCost of sales\n(51,902)\n(47,118)\nTotal assets\n65,990\n—", "table"),
    ("Sales,88120,79004,71220\nCosts,51902,47118,44016\nProfit,36218,31886,27204", "table"),
    ("March 3   —   $25,110   98,204   41.2%\nJune 19   (4,120)   $7,781   12,230   9.8%\nMay 7   8,812   —   61,003   17%", "table"),
    ("qwx rtzz kkpl vbnm sdfg hjkl zxcvb nmlk wrtp qqzx dfgh jkll mnbv", "junk"),
    ("#@!% ^&*< >?|~ =+_# @@!! %%^^ &*<> |~#@ !=+_ <<>> ^^~~ @#%", "junk"),
    ("8_1-z9.x=02-yz_7y.x18-z0=29_zx-44y.9_x=1z-83.yx_02=9-z7", "junk"),
    ("Ã¼berÃ¤ Ð´Ã¶r â€œÃ©tÃ§â€™ Ã±oÅ¡ Ã¸rÃ¶Ã¼ Â§Ã©lÃ¤ Ã§â€“Ã±", "junk"),
    ("T h e f ur na ce s h ut d ow n fo r r ep ai r i n M a y an d r es ta rt ed l at er", "junk"),
    ("Home » Login » Search 31 » Share » Print » Sitemap » Careers » Legal 7 » Press » Top", "junk"),
    ("glass depot 77ab01 glass depot 77ab01 glass depot 77ab01 glass depot 77ab01 glass depot 77ab01", "junk"),
    ("Menu\nLogin\nSearch 12\nShare\nPrint\nHelp\nTop\nSitemap\nPress 4", "junk"),
]
TITLES = [
    ("Risk Factors", 0), ("Legal Proceedings", 0), ("BUSINESS", 0), ("controls and procedures", 0), ("Item 7. Management's Discussion and Analysis", 0), ("Note 12: Leases", 0),
    ("Properties", 0), ("Mine Safety Disclosures", 0), ("risk factors", 0), ("Exhibits and Financial Statement Schedules", 0), ("Item 1B. Unresolved Staff Comments", 0),
    ("Selected Financial Data (continued)", 0), ("Full Document", 0), ("business", 0), ("legal proceedings", 0), ("Cover Page", 0), ("Directors, Executive Officers and Corporate Governance", 0),
    ("EXECUTIVE COMPENSATION", 0), ("Market for Registrant's Common Equity", 0), ("properties", 0), ("Signatures", 0), ("Note 4: Income Taxes", 0), ("Item 3. Legal Proceedings", 0),
    ("Risk Factors ........ 17", 1), ("Legal Proceedings\t31", 1), ("112", 1), ("F-23", 1), ("__________", 1), ("§§ ---", 1), ("xvii | 09af3c", 1), ("Table of Contents 14", 1), ("sdkfjaslzx", 1),
    ("qzhxvjw", 1), ("akhsgfadxl", 1), ("ProperÃ¢â‚¬ies", 1), ("Busi� ss", 1), ("lkzxaqh", 1), ("- 47 -", 1), ("ghadjsfkq", 1), ("-----", 1), ("zxlhfas", 1), ("Page 12 of 90", 1), ("Business     9", 1),
    ("We depend on a single supplier of glass for most of our products.", 2), ("In 2020, net sales rose 9 percent because of higher prices.", 2), ("The lease of the depot ends in May.", 2),
    ("Two employees left the plant without notice in 2019.", 2), ("The value of the bonds uses a rate of 4.1%.", 2), ("Any failure of the furnace would hurt our results; as a result, we may lose customers.", 2),
]

HELD_TITLES = [(t, 0) for t in (
    "Legal Matters|Employees and Labor Relations|Competition|Government Regulation|Item 2. Properties|ITEM 1A. RISK FACTORS|Quantitative and Qualitative Disclosures about Market Risk|Note 7. Inventories|Note 2 - Summary of Policies|Critical Accounting Estimates|"
    "liquidity and capital resources|Changes in Internal Control|Segment Information|Subsequent Events|Dividends|stock repurchases|Report of Independent Auditors|Part II|Code of Ethics|Seasonality|Raw Materials|Item 9A. Controls and Procedures|Forward-Looking Statements|Principal Accountant Fees and Services|"
    "Off-Balance Sheet Arrangements|Results of Operations (continued)|Item 10. Directors and Executive Officers|Intellectual Property|Where You Can Find More Information|Insurance|Backlog|CYBERSECURITY|Exhibit Index|Available Information|Note 15: Commitments and Contingencies"
).split("|")] + [(t, 1) for t in (
    "Risk Factors..............12|Properties ....... 8|Legal Proceedings    23|Table of Contents 7|27|F-4|iii|________|****|- 12 -|Page 3 of 44|= = = =|mzxkqpw|lkjhgfds|qpwzmx|Bus\ufffdness|PropertÃ©Â©es|Ã‚Â§ 4|#7f3a9c|0x00a1 | 77be|xv | 8c21d0|Item 3 ___ 19|Competition\t14|… 31|> 9 <|SEC 1344|kjdsfhkwq|"
    "Report.....41|---- 6 ----|%%EOF|\\x93\\x94|zzqk vvxr|1,204|17/88|wqrtpl"
).split("|")] + [(t, 2) for t in (
    "The company leases two plants in the north of the country.|We expect higher costs in the second half of the year.|Sales of pumps fell by 4 percent in 2019 because of the strike.|No member of the board owns shares of the bank.|Our auditors have issued an opinion on the controls.|Prices of gas rose sharply, and margins fell as a result.|"
    "In May 2021 the court dismissed the claim of the former supplier.|We do not believe that the outcome will be material.|The furnace was shut for repairs for most of the winter.|Our customers may cancel their orders at any time without penalty.|About 300 people work in the laboratory near the harbour.|The notes bear interest at 5.2% and mature in 2027.|"
    "Any delay at the port could harm our ability to deliver on time.|These estimates depend on the price of fuel and on the weather.|The tribunal has not yet set a date for the hearing.|Management reviewed the lease and found that it was in order."
).split("|")]
TEST_TITLES = [(t, 0) for t in (
    "Human Capital|Environmental Matters|Item 5. Market Information|Note 11 Income Taxes|Overview|Customers|Patents and Trademarks|research and development|Item 15. Exhibits|Corporate Governance|Stock Performance Graph|Related Party Transactions|Working Capital|ITEM 3. LEGAL PROCEEDINGS|Summary Compensation Table|Revenue Recognition|mine safety disclosures|Holders of Record|Executive Summary|Pension Plans"
).split("|")] + [(t, 1) for t in (
    "Overview ........... 3|Customers    11|88|S-12|...........|/////|hgfdkjq|xqzwv|Propert\ufffd\ufffds|LeasÃ¢â‚¬s|Page 9|- 3 -|ix|a91f0|Table of Contents 63|Patents\t5|==|wrtzk|21 | 22"
).split("|")] + [(t, 2) for t in (
    "We lease the depot from a former director of the company.|Demand for cranes rose in the spring of 2022.|The rate on the loan changes every three months.|Two suppliers stopped their deliveries after the flood.|We have no plans to sell the mill.|The claim was settled in October for a small amount.|If the permit lapses, the mine will have to close.|Most of the pallets are made of wood from nearby forests."
).split("|")]
_MORE_PROSE = [
    "The bank may call the loan if our ratio of debt to equity rises above the limit, which would force us to sell assets at a poor time.", "During the year we moved the laboratory to a new building near the river, and about forty people joined the group that works on coatings.",
    "Competition in our markets is strong. Many rivals are larger than we are and can accept lower prices for longer than we can.", "On 4 March the tribunal heard the case of the former dealers, who say that we ended their contracts without cause.",
    "We use hedges to limit the effect of changes in the price of gas. They don't remove the risk, because volumes can't be known in advance.", "Der Umsatz stieg im Jahr 2021 um neun Prozent, weil die Preise für Glas höher waren und die neue Anlage früher als geplant in Betrieb ging.",
    "La société estime que le litige avec son ancien fournisseur n'aura pas d'effet important sur ses comptes de l'exercice.", "El consejo aprobó en mayo la venta de la planta del norte, que ya no era necesaria para atender los pedidos de los clientes.",
]
_MORE_LISTS = [
    "• charter\n• bylaws\n• lease of the mill\n• consent of the auditor\n• list of subsidiaries", "* cranes and hoists\n* cable\n* spare gears\n* hydraulic oil", "(i) sale of the ferry\n(ii) purchase of two tugs\n(iii) lease of a berth\n(iv) repair of the quay",
    "Hull\nLeeds\nYork\nDover\nGrimsby\nWhitby\nSelby", "- number of dealers\n- price of scrap\n- rate of interest\n- length of the winter\n- cost of freight", "1) Office of the secretary\n2) Office of the auditor\n3) Works council\n4) Safety board",
    "Board of Directors\nAudit Committee\nPay Committee\nNominating Committee\nSafety Committee", "– glass\n– timber\n– coal\n– grain\n– salt",
]
_MORE_TABLES = [
    "2022    2021    2020\nSales    812.4    790.1    702.9\nCosts    (610.0)    (598.2)    (540.7)\nTax    (40.1)    (38.8)    (31.0)", "Plant\tArea\tOwned\nHull\t12,000\tyes\nLeeds\t8,400\tno\nYork\t3,150\tyes", "Pumps ..... 4,120\nValves ..... 3,977\nSeals ..... 882\nTotal ..... 8,979",
    "Quarter,High,Low\n1,41.20,36.05\n2,44.90,39.11\n3,40.02,33.78\n4,38.66,30.10", "| Rate | 2021 | 2020 |\n| Base | 4.1% | 3.8% |\n| Peak | 6.0% | 5.5% |", "Net debt\n1,204\n1,118\nEquity\n2,950\n2,711\nRatio\n0.41\n0.41",
    "Age   Cost   Net\n1-3   $4,100   $3,820\n4-7   $9,050   $6,300\n8-12   $2,240   $980", "Wages  (88,120)  (81,004)\nRent  (7,300)  (7,150)\nFuel  (19,884)  (16,320)",
]
_MORE_JUNK = [
    "xkcd qwpr zmvn tplk rrwq hjkl bnmx qzpw vbkt ldfg mnrt wqsx", "%%$$ ##@! ^&*( )_+= <>?: {}|~ ^^&& **(( ))__ ++== ??>>", "9f3ac1 77d0e2 b41c9a 0f8e33 d2a7c1 55b09e 1c7f4d a0e981 3bd6f2", "Ã¤Ã¶Ã¼ Â©Â® â€œâ€ Ã±Ã© Ã¨Ã  Â§Â¶ Ã¸Ã¥ Ã§ÃŸ â€“â€”",
    "t he m i ll w a s s ol d i n t he s pr in g of th e y ea r a nd th en r e bu il t", "Home | About | News | Contact | Login | Help | Top | Share | Print", "barge 12ff barge 12ff barge 12ff barge 12ff barge 12ff barge 12ff barge 12ff", "AAAAB3NzaC1yc2EAAAADAQABAAABgQC7Zk9vW3hYxP0qLm8sT4uVjR2nKfGdEw6Bz1XoCyHi5aMtUe",
]
TEST_SEGMENTS = [(t, c) for ts, c in ((_MORE_PROSE[1::2], "prose"), (_MORE_LISTS[1::2], "list"), (_MORE_TABLES[1::2], "table"), (_MORE_JUNK[1::2], "junk")) for t in ts]
SEGMENTS += [(t, c) for ts, c in ((_MORE_PROSE[::2], "prose"), (_MORE_LISTS[::2], "list"), (_MORE_TABLES[::2], "table"), (_MORE_JUNK[::2], "junk")) for t in ts]
