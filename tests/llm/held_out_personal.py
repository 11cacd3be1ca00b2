"""Sentences written by hand, apart from the generator's contexts and name lists, with their cases."""

SENTENCES = [
    ("We had coffee with Rosalind Hargreaves after the concert.", [("name", "Rosalind Hargreaves")]),
    ("Minutes taken by Gregor Tannhauser on behalf of the board.", [("name", "Gregor Tannhauser")]),
    ("Nobody has seen Mrs. Pemberton since Tuesday.", [("name", "Pemberton")]),
    ("Photograph courtesy of Delphine Marchetti.", [("name", "Delphine Marchetti")]),
    ("If in doubt, speak to Dr Ravindran at the front desk.", [("name", "Ravindran")]),
    ("The second witness, T. Abernathy, did not appear.", [("name", "T. Abernathy")]),
    ("Winner: Beatrix Lindholm", [("name", "Beatrix Lindholm")]),
    ("Kindly forward the minutes to Winifred Ashdown before lunch.", [("name", "Winifred Ashdown")]),
    ("The cello once played by Mr Thornbury is for sale.", [("name", "Thornbury")]),
    ("Driver today: Calloway, Desmond", [("name", "Calloway, Desmond")]),
    ("Her emergency contact can be reached on 07700 900142.", [("phone", "07700 900142")]),
    ("For repairs dial (212) 555-0147 between nine and five.", [("phone", "(212) 555-0147")]),
    ("Our landline changed to 01632 960 983.", [("phone", "01632 960 983")]),
    ("WhatsApp +44 20 7946 0811 works best.", [("phone", "+44 20 7946 0811")]),
    ("Leave a voicemail at 555-867-5309.", [("phone", "555-867-5309")]),
    ("Emergency line: 020 7946 0958", [("phone", "020 7946 0958")]),
    ("You can page the vet on 555-0199 all night.", [("phone", "555-0199")]),
    ("Any questions go to helen.marsh@gardenclub.org.", [("email", "helen.marsh@gardenclub.org")]),
    ("Receipts: accounts+june@brightwater.co.uk", [("email", "accounts+june@brightwater.co.uk")]),
    ("You may subscribe via newsletter-team@quietpress.net today.", [("email", "newsletter-team@quietpress.net")]),
    ("The old contact was r.fox (at) meadow (dot) org.", [("email", "r.fox (at) meadow (dot) org")]),
    ("Complaints reach k_ludlow@harbour-trust.com within a day.", [("email", "k_ludlow@harbour-trust.com")]),
    ("Applicant's social security number: 219-09-9999.", [("id_number", "219-09-9999")]),
    ("Copy of passport 533401372 attached.", [("id_number", "533401372")]),
    ("Insurance number AB 12 34 56 C was missing.", [("id_number", "AB 12 34 56 C")]),
    ("His driver's licence reads D410-332-817-904.", [("id_number", "D410-332-817-904")]),
    ("Please note your national ID 4821 7735 9012 before the visit.", [("id_number", "4821 7735 9012")]),
    ("The parcel went to 48 Harcourt Terrace, Durham DH1 4NQ by mistake.", [("address", "48 Harcourt Terrace, Durham DH1 4NQ")]),
    ("Viewing on Sunday: 7B Larkspur Road, Whitby.", [("address", "7B Larkspur Road, Whitby")]),
    ("Our office is at 1600 Juniper Avenue, Boulder, CO 80302.", [("address", "1600 Juniper Avenue, Boulder, CO 80302")]),
    ("Post for Flat 12, 90 Quayside Court, Exeter arrived today.", [("address", "Flat 12, 90 Quayside Court, Exeter")]),
    ("Order number 219-09-9999 shipped last night.", []),
    ("Component 555-0147 is no longer made.", []),
    ("The firmware is now at 4.12.8801.", []),
    ("Juniper Avenue in Boulder will be resurfaced.", []),
    ("ISBN 978-0-553-21311-7 was reprinted.", []),
    ("Thanks to @larkspur-crew for fixing build 7.310.2204.", []),
    ("In 1998 the theatre in Whitby sold 2,450 tickets at 7.50 each.", []),
    ("The choir sang from nine to half past ten.", []),
    ("We walked from Harcourt to Whitby along the river.", []),
    ("Article 4471-2290 comes in blue.", []),
    ("Das Protokoll führte Gisela Brandt.", [("name", "Gisela Brandt")]),
    ("Herr Ostermann bringt morgen das Werkzeug.", [("name", "Ostermann")]),
    ("Notfalls hilft Frau Lindenthal weiter.", [("name", "Lindenthal")]),
    ("Unsere neue Anschrift lautet Birkenweg 14, 79098 Freiburg.", [("address", "Birkenweg 14, 79098 Freiburg")]),
    ("Sie erreichen uns mobil: 0171 4455667.", [("phone", "0171 4455667")]),
    ("Rückfragen gern an buero@waldkauz.de.", [("email", "buero@waldkauz.de")]),
    ("Die Bestellnummer 4402-118-2231 fehlt.", []),
    ("Der Birkenweg in Freiburg ist gesperrt.", []),
    ("Le procès-verbal est signé par Solène Garnier.", [("name", "Solène Garnier")]),
    ("Mme Vasseur passera demain matin.", [("name", "Vasseur")]),
    ("Le cabinet se trouve 8, rue des Tilleuls, 69003 Lyon.", [("address", "8, rue des Tilleuls, 69003 Lyon")]),
    ("Laissez un message au 06 12 34 56 78.", [("phone", "06 12 34 56 78")]),
    ("Toute question à mairie@valdoise.fr.", [("email", "mairie@valdoise.fr")]),
    ("La rue des Tilleuls à Lyon est en travaux.", []),
    ("会計の報告は大野真理子がまとめた。", [("name", "大野真理子")]),
    ("三浦さんに鍵を渡した。", [("name", "三浦")]),
    ("講師は平野 健司先生です。", [("name", "平野 健司")]),
    ("事務所は静岡市葵区追手町9番6号にある。", [("address", "静岡市葵区追手町9番6号")]),
    ("緊急時は090-1234-5678へ。", [("phone", "090-1234-5678")]),
    ("質問は info@sakura-kai.jp まで。", [("email", "info@sakura-kai.jp")]),
    ("商品番号 4471-2290-118 は品切れ。", []),
    ("静岡で大きな祭りがあった。", []),
]
