"""A document with all kinds of personal data, and what the filter has to find in it (fixed values)."""

TEXT = """\
Cliëntdossier – testdocument anonimisatie (dummy data)Datum opmaak: 07-02-2026Organisatie: Stichting Zonnewende Zorg (test)Locatie: De Lijsterhof, afdeling 2B
In dit document staan testgegevens die uitsluitend bedoeld zijn om het anonimiseren te testen. De cliënt is geregistreerd onder de naam mevrouw Anna de Vries, geboren op 14-03-1948, met een test-BSN 123456782. De contactpersoon is haar zoon, de heer Jeroen de Vries, telefoonnummer 06-12345678 en e-mailadres jeroen.devries@testmail.example. Als tweede contactpersoon staat vermeld: "M. van der Meer" (mantelzorger), bereikbaar via 020 123 45 67 en via m.vandermeer@testmail.example.
Het bezoekadres van de cliënt staat genoteerd als: Parklaan 12, 1017 AB Amsterdam. Het factuuradres staat apart vermeld als: t.a.v. A. de Vries, Postbus 203, 1000 AE Amsterdam. In het ECD is daarnaast een oud adres terug te vinden: Van Woustraat 99 hs, 1074 AD Amsterdam, met een notitie dat dit adres niet meer actueel is sinds 01-09-2022.
In het ECD is daarnaast een oud adres terug te vinden: Van Woustraat 99 hs, 1074 AD Amsterdam, met een notitie dat dit adres niet meer actueel is sinds 01-09-2022.
Tijdens het intakegesprek was wijkverpleegkundige drs. Sanne Jansen aanwezig, samen met verzorgende IG Pieter-Jan Kuipers. In het verslag is opgenomen dat Sanne Jansen de medicatielijst heeft doorgenomen en dat Pieter-Jan Kuipers de thuissituatie heeft besproken. De huisarts die in het systeem staat is "Dr. A. Smit", praktijk "Huisartsenpraktijk De Brug", telefoon 010-98765432. Als apotheek staat geregistreerd: Apotheek 't Centrum, tel. 035-1112233, met contactpersoon "Fatima El Amrani".
A. Smit", praktijk "Huisartsenpraktijk De Brug", telefoon 010-98765432. Als apotheek staat geregistreerd: Apotheek 't Centrum, tel. 035-1112233, met contactpersoon "Fatima El Amrani".
In de dagelijkse rapportage van 05-02-2026 is geschreven dat Anna de Vries onrustig was in de ochtend en vroeg naar "Lotte". Later op de dag werd vermeld dat "Mevr. de Vries" meer ontspannen was na bezoek van Jeroen. In een korte notitie staat ook: "mw Devries vroeg naar haar zus: Marijke." In een andere regel staat de naam in omgekeerde volgorde: "De Vries, Anna" en in een overdrachtsregel staat alleen: "A. de Vries".
naam in omgekeerde volgorde: "De Vries, Anna" en in een overdrachtsregel staat alleen: "A. de Vries".
Er is een medisch meetmoment geregistreerd met als identificatie: cliëntnummer CL-948271, en een tweede registratienummer: Dossier-ID 2026/02/07-XY. In het systeem staat ook een personeelsverwijzing naar medewerker "Nienke van 't Hof", met telefoon 06 87654321. In een bijlage staat een afspraakbevestiging met de naam "Jean-Luc van Damme" als fysiotherapeut, praktijkadres: Keizersgracht 5, 1015 CC Amsterdam, e-mail: jeanluc.vandamme@testmail.example.
Onderstaande passage bevat expres lastige tekstopmaak zoals afbrekingen en regeleinden, zodat je kunt testen of namen alsnog blijven staan door PDF/OCR-achtige ruis.De cliënt is gezien door Mevr. An-na de Vries en haar contactpers-oon Jeroen de Vries. De zorgme-dewerker P. J. Kuipers heeft toe-lichting gegeven over het plan.
An-na de Vries en haar contactpers-oon Jeroen de Vries. De zorgme-dewerker P. J. Kuipers heeft toe-lichting gegeven over het plan.
In het zorgplan staat dat de cliënt hulp nodig heeft bij ADL en dat de medicatie wordt toegediend volgens schema. In de opmerkingen is genoteerd dat "Sanne" heeft gebeld met "Fatima" van de apotheek over een herhaalrecept. Verder staat in de vrije tekst: "Graag terugkoppelen aan Van der Meer (mantelzorger) na het weekend."
Er is ook een losse regel opgenomen met alleen hoofdletters om te testen op herkenning van namen in caps: "CONTACT: JEROEN DE VRIES". Verder staat er een variant met een tussenvoegsel en meerdere spaties: "Anna van der Velde" en een variant met een koppelteken: "Noor-Jane Koster-van Dijk". In een interne notitie staat een e-mailhandtekening met naam en mobiele nummer: "Met vriendelijke groet, Bram Oosterhuis | 06-22223333".
In een interne notitie staat een e-mailhandtekening met naam en mobiele nummer: "Met vriendelijke groet, Bram Oosterhuis | 06-22223333".
Voor testdoeleinden staan hieronder extra identifiers die je tool zou moeten weghalen, zoals geboortedata, telefoonnummers, e-mails en test-BSN's (niet-elfproef).De heer K. Bakker, geboren op 01-01-1970, test-BSN 987654321, telefoon 088-1200300, e-mail: k.bakker@testmail.example.Mevrouw L. van Rijn, geboren 31-12-1962, test-BSN 111222334, telefoon +31 6 99998888, e-mail: l.vanrijn@testmail.example.De heer "O. Çelik", geboortedatum 02-02-1982, test-BSN 222333445, telefoon 070 333 44 55, e-mail: o.celik@testmail.example.Mevrouw "Zoë d'Angelo", geboortedatum 10-10-1990, test-BSN 333444556, telefoon 030-4445566, e-mail: zoe.dangelo@testmail.example.
geboortedatum 10-10-1990, test-BSN 333444556, telefoon 030-4445566, e-mail: zoe.dangelo@testmail.example.
Tot slot staat er een korte passage met alleen initialen en achternaam, omdat die vaak gemist wordt door naïeve filters: "Overleg gehad met J.B. de Wit en M.C. van Leeuwen over vervolgafspraak." Ook staat er een passage met een naam tussen aanhalingstekens: "Cliënt noemde 'Hicham' en 'Elize' als vertrouwde gezichten." In de bijlage staat één regel met "BSN: 444555667" en één regel met "Tel: 06–10101010", waarbij het streepje expres anders is dan normaal."""

#: Names that people who read the document expect to be found, in whole or in part.
EXPECTED_NAMES = (
    "Anna de Vries",
    "Jeroen de Vries",
    "M. van der Meer",
    "Sanne Jansen",
    "Pieter-Jan Kuipers",
    "A. Smit",
    "Fatima El Amrani",
    "Lotte",
    "Marijke",
    "Nienke van 't Hof",
    "Jean-Luc van Damme",
    "P. J. Kuipers",
    "Van der Meer",
    "Anna van der Velde",
    "Noor-Jane Koster-van Dijk",
    "Bram Oosterhuis",
    "K. Bakker",
    "L. van Rijn",
    "O. Çelik",
    "Zoë d'Angelo",
    "J.B. de Wit",
    "M.C. van Leeuwen",
    "Hicham",
    "Elize",
    "De Vries, Anna",
    "A. de Vries",
    "Anna",
    "Jeroen",
    "Sanne",
    "Fatima",
)

#: Type, number, start and end of every match, in order.
MATCHES = (
    ("date", 1, 68, 78), ("name", 1, 101, 116), ("name", 2, 303, 316), ("date", 2, 318, 339),
    ("bsn", 1, 358, 367), ("name", 3, 409, 424), ("phone", 1, 441, 452), ("email", 1, 468, 499),
    ("name", 4, 543, 558), ("phone", 2, 591, 604), ("email", 2, 612, 641), ("address", 1, 694, 705),
    ("postcode", 1, 707, 714), ("name", 5, 775, 786), ("postcode", 2, 801, 808), ("address", 2, 879, 894),
    ("postcode", 3, 896, 903), ("date", 3, 972, 982), ("address", 3, 1043, 1058), ("postcode", 4, 1060, 1067),
    ("date", 4, 1136, 1146), ("name", 6, 1203, 1215), ("name", 7, 1251, 1269), ("name", 6, 1303, 1315),
    ("name", 7, 1359, 1377), ("name", 8, 1457, 1464), ("phone", 3, 1515, 1527), ("phone", 4, 1589, 1600),
    ("name", 9, 1622, 1638), ("name", 8, 1641, 1648), ("phone", 5, 1699, 1711), ("phone", 6, 1773, 1784),
    ("name", 9, 1806, 1822), ("date", 5, 1857, 1867), ("name", 2, 1886, 1899), ("name", 10, 1942, 1947),
    ("name", 2, 1993, 1998), ("name", 3, 2034, 2040), ("name", 11, 2078, 2085), ("name", 12, 2107, 2114),
    ("name", 2, 2179, 2184), ("name", 2, 2186, 2190), ("name", 5, 2234, 2245), ("name", 2, 2281, 2286),
    ("name", 2, 2288, 2292), ("name", 5, 2336, 2347), ("name", 13, 2566, 2583), ("phone", 7, 2599, 2610),
    ("name", 14, 2670, 2688), ("address", 4, 2725, 2740), ("postcode", 5, 2742, 2749), ("email", 3, 2769, 2802),
    ("name", 2, 3009, 3014), ("name", 3, 3039, 3054), ("name", 15, 3075, 3088), ("name", 2, 3140, 3145),
    ("name", 3, 3170, 3185), ("name", 15, 3206, 3219), ("name", 6, 3412, 3417), ("name", 9, 3437, 3443),
    ("name", 4, 3542, 3554), ("name", 3, 3703, 3718), ("name", 16, 3793, 3811), ("name", 17, 3850, 3875),
    ("name", 18, 3983, 3998), ("phone", 8, 4001, 4012), ("name", 18, 4120, 4135), ("phone", 9, 4138, 4149),
    ("name", 19, 4322, 4331), ("date", 6, 4333, 4354), ("bsn", 2, 4365, 4374), ("phone", 10, 4385, 4396),
    ("email", 4, 4406, 4431), ("name", 20, 4440, 4451), ("date", 7, 4461, 4471), ("bsn", 3, 4482, 4491),
    ("phone", 11, 4502, 4516), ("email", 5, 4526, 4552), ("name", 21, 4562, 4570), ("date", 8, 4587, 4597),
    ("bsn", 4, 4608, 4617), ("phone", 12, 4628, 4641), ("email", 6, 4651, 4675), ("name", 22, 4685, 4697),
    ("date", 9, 4714, 4724), ("bsn", 5, 4735, 4744), ("phone", 13, 4755, 4766), ("email", 7, 4776, 4804),
    ("date", 10, 4820, 4830), ("bsn", 6, 4841, 4850), ("phone", 14, 4861, 4872), ("email", 8, 4882, 4910),
    ("name", 23, 5052, 5063), ("name", 24, 5067, 5083), ("name", 25, 5186, 5192), ("name", 26, 5198, 5203),
    ("bsn", 7, 5272, 5281), ("phone", 15, 5301, 5317),
)

#: Names in the document, in its order, that a lexicon has to hold for all of it to be found.
FIRST = (
    "Anna", "Jeroen", "Sanne", "Jan", "Pieter", "Fatima", "Lotte", "Marijke", "Nienke", "Jean", "Luc", "Noor", "Jane", "Bram", "Zoë",
    "Hicham", "Elize",
)
LAST = (
    "Vries", "Kuipers", "Smit", "Rijn", "Çelik", "Wit", "Leeuwen",
)
