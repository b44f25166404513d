"""A general thesaurus of accounting and utility words, and what a text says in terms of it.

A concept gathers single words of several languages that mean the same, as any dictionary gives them; it knows
nothing of the canonical list it is used with and holds no labels. Words are written folded (small, no accents); a
star lets any ending follow, all others take the common endings. Unknown words are compounds of known ones, or are
looked up through their character n-grams and a weighted edit distance.
"""

from __future__ import annotations

import re
from collections import defaultdict

from gridloom.operators.units import edit_cost, grams

CONCEPTS = {
    # money in and out
    "INCOME": "income incomes revenue revenues takings proceeds receipt receipts earned turnover einnahme einnahmen erlos erlose ertrag ertrage umsatz umsatze recette recettes revenu produit produits ingreso ingresos proventi ricavi receita receitas opbrengst opbrengsten inkomsten",
    "COST": "cost costs expense expenses expenditure charge charges fee fees outlay spend spending kosten aufwand aufwendung* ausgabe ausgaben frais cout couts dotation dotations derechos depense depenses gasto gastos coste costo costes costi spese custo custos kosten lasten gebuhr gebuhren redevance redevances tasa tasas",
    "PRICE": "price prices tariff tariffs preis preise tarif tarife prix tarifa precio prezzo tariffa preco prijs",
    "PAY": "pay pays paid payment payments zahlung zahlungen bezahlt gezahlt paye payes paiement paiements verse versee verses pagado pagados pagada pago pagos pagato betaald betaling",
    "SELL": "sale sales sell sells selling sold verkauf verkaufe vente ventes vendu venta ventas vendido vendita vendite venda vendas verkoop",
    "BUY": "purchase purchases purchased buy buys buying bought procure procured procurement bezug einkauf einkaufe kauf achat achats achete compra compras comprada acquisto acquisti inkoop",
    "MONEY": "money cash funds fund geld fonds dinero denaro",
    "TAX": "tax taxes taxation steuer steuern impot impots taxe taxes impuesto impuestos imposta imposte tassa imposto impostos belasting",
    "LEVY": "levy levies rates duty duties tax taxes steuer steuern abgabe abgaben taxe impot impuesto imposta imposto belasting",
    "SUBSIDY": "subsidy subsidies grant grants support aid funding contribution contributions zuschuss zuschusse fordermittel subvention subventions subvencion subvenciones ayuda ayudas contributo contributi subsidio",
    "PREMIUM": "premium premiums pramie pramien prime primes prima primas premi",
    # what it is about
    "TOLL": "toll tolls tollway maut peage peages peaje peajes pedaggio pedaggi portagem",
    "ROADUSER": "road roads motorist motorists driver drivers motorway highway traffic vehicle vehicles strasse strassen autobahn route routes autoroute carretera automobilist*",
    "WATER": "water waters wasser eau eaux agua aguas acqua acque",
    "POTABLE": "potable drinking drink trink potabel",
    "SEWAGE": "sewage sewer sewers wastewater effluent abwasser assainissement alcantarillado fognatura rioolwater",
    "WASTE": "waste used wastewater sewage abwasser usee usees residual residuales reflue",
    "ELECTRIC": "electricity electric electrical power energy strom elektrizitat energie courant electricit* electriq* electric* energia elettricit* eletricidade stroom",
    "CONNECT": "connection connections connect connecting join joining hookup hook anschluss anschlusse raccordement branchement conexion conexiones acometida allacciamento aansluiting",
    "NETWORK": "network networks grid mains netz netze reseau reseaux red redes rete reti rede netwerk connection connections connecting join joining anschluss raccordement",
    "DEVELOPER": "developer developers promoter promoters bautrager",
    "RENT": "rent rents rental rentals lease leases leasing tenant tenants lessee tenancy miete mieten mieter pacht pachten loyer loyers locati* locataire alquiler alquileres arrendamiento arrendamientos affitto affitti aluguel huur",
    "PUBLIC": "public state government governmental federal municipal authority offentlich* staat staatlich* public* etat gouvernement publico publica publicas publicos estado pubblico pubblici overheid",
    "STAFF": "staff personnel personal people employee employees workforce worker workers labour labor crew mitarbeiter personale personeel empleado empleados employes salaries",
    "WAGE": "wage wages salary salaries payroll pay lohn lohne gehalt gehalter salaire salaires sueldo sueldos salario salarios stipendi lonen staff personnel personal people employee employees",
    "MAINTAIN": "maintenance maintain maintaining upkeep keeping keep repair repairs servicing wartung instandhaltung unterhalt reparatur* entretien reparation reparations mantenimiento reparaciones conservacion manutenzione manutencao onderhoud",
    "ROUTINE": "routine regular ordinary current planned laufend* courant courants ordinario ordinaria corriente ordinaire",
    "CHEMICAL": "chemical chemicals reagent reagents chlorine lime coagulant coagulants alum fluoride polymer polymers caustic ozone flocculant additive additives dosing chemikalie chemikalien chimique chimiques reactif reactifs quimico quimicos quimica reactivo reactivos chimici chimico chemicalien",
    "TREAT": "treatment treat treated treating purified aufbereit* behandelt behandelte behandlung gereinigt* traite traitee traites traitees traitement tratado tratada tratadas tratamiento trattato trattate trattamento gezuiverd*",
    "INSURE": "insurance insurances insured cover policy policies underwriting versicherung versicherungen police assurance assurances seguro seguros assicurazione assicurazioni verzekering verzekeringen",
    "LAND": "land grund grundstuck* boden property real foncier fonciere fonciers inmueble inmuebles territorial terreno terrain council local terreni grond",
    "PROPERTY": "property estate immobilie* bienes immobili* inmueble inmuebles",
    "AMORTISE": "depreciation depreciate depreciated amortisation amortization amortise amortised amortize writedown spreading spread allocation allocated abschreibung abschreibungen amortissement amortissements amortizacion amortizaciones depreciacion depreciaciones ammortament* amortizacao afschrijving afschrijvingen",
    "WEAR": "wear worn depreciation abnutzung usure desgaste usura slijtage",
    "LIFE": "life lives lifetime lebensdauer vida vita levensduur",
    "ASSET": "asset assets plant equipment installation installations facilities anlage anlagen immobilisation immobilisations instalacion instalaciones inmovilizado activos impianto impianti ativos installaties bien biens bienes sachanlage* infrastructure infrastruktur",
    "PIPE": "pipe pipes pipeline pipelines piping mains conduit rohr rohre rohren leitung leitungen conduite conduites tuyau tuyaux canalisation* tuberia tuberias tubazion* condotte leiding leidingen",
    "PUMP": "pump pumps pumpe pumpen pompe pompes bomba bombas",
    # results and capital
    "RESULT": "result results profit profits earnings surplus income gain ergebnis ergebnisse gewinn gewinne uberschuss resultat resultats benefice benefices resultado resultados beneficio beneficios ganancia risultato utile lucro resultaat winst",
    "NET": "net netto nette nets neto neta left bottom final ultimate everything",
    "ANNUAL": "after annual jahresuberschuss",
    "OPERATE": "operating operation operations operational operativ* operative betrieb betriebs betrieblich* exploitation operationnel* explotacion operativo operativa esercizio gestione bedrijfs",
    "FINANCEITEMS": "finance financial items",
    "COMPANY": "company companies corporate corporation business firm korperschaft unternehmen societe societes sociedad sociedades entreprise empresa empresas societa impresa vennootschap",
    "PROFITTAX": "profit profits income earnings ertrag ertrage gewinn benefice benefices beneficio beneficios",
    "DEFERRED": "deferred timing latent latente latenten later differe differes differee diferido diferidos diferida differite differita uitgesteld*",
    "RECEIVABLE": "receivable receivables debtor debtors forderung forderungen debitor debitoren creance creances cobrar deudor deudores crediti credito vordering vorderingen",
    "PAYABLE": "payable payables creditor creditors bills verbindlichkeit verbindlichkeiten kreditoren dette dettes pagar acreedor acreedores debiti schulden crediteuren liability liabilities",
    "TRADE": "invoice invoices bill bills rechnung rechnungen facture factures factura facturas fattura fatture factuur facturen trade commercial commerciale* lieferung lieferungen leistungen comercial comerciales commerciali handel supply accounts cuentas",
    "CLIENT": "client clients customer customers buyer buyers kunde kunden abnehmer cliente clientes clienti klant klanten",
    "RETAIL": "retail retailer retailers household households customer customers client clients",
    "VENDOR": "vendor vendors supplier suppliers contractor contractors lieferant lieferanten fournisseur fournisseurs proveedor proveedores fornitore fornitori fornecedor* leverancier*",
    "OWE": "owe owed owing due debt debts dette dettes deuda deudas schuld schulden unpaid",
    "UNPAID": "unpaid outstanding open overdue still offen offene offenen impaye impayes pendiente pendientes",
    "STOCK": "stock stocks store stores inventory inventories spare spares goods material materials vorrat vorrate lager lagerbestand lagerbestande piece pieces existencias inventario inventarios rimanenze scorte estoque voorraad voorraden",
    "BANK": "bank banks banken bancaire bancaires bancario bancaria bancarios banco bancos banca banche",
    "LIQUID": "cash liquid liquidity kasse kassen bargeld flussig* liquide liquides tresorerie caisse efectivo tesoreria caja liquidita cassa caixa kas",
    "BALANCE": "liability liabilities provision provisions position passive aktive balance balances bestand bestande guthaben saldo saldos solde soldes disponible disponibles",
    "CONCESSION": "concession concessions licence licences license franchise konzession konzessionen lizenz lizenzen concesion concesiones licencia concessione concessioni licenza concessao concessie",
    "RIGHT": "right rights intangible intangibles recht rechte droit droits derecho derechos diritto diritti direito",
    "LOAN": "loan loans facility borrowing borrowings borrowed lending credit credits facility debt debts lender lenders darlehen kredit kredite anleihe schuld schulden emprunt emprunts pret prets dette dettes prestamo prestamos credito creditos deuda deudas prestito prestiti mutuo emprestimo* lening leningen",
    "LENDER": "lender lenders banks banken preteur preteurs prestamista prestamistas kreditgeber",
    "SENIOR": "senior vorrangig* prioritaire*",
    "OWNER": "owner owners shareholder shareholders sponsor sponsors partner stockholder stockholders gesellschafter aktionar aktionare eigner eigentumer actionnaire actionnaires associe associes accionista accionistas socio socios azionist* soci aandeelhouder*",
    "RETAIN": "retained retain accumulated undistributed reserve reserves carried rucklage rucklagen einbehalten* thesauriert* reporte accumule accumules retenido retenidos acumulado acumulada acumuladas acumulados reservas riserve portati",
    "CAPITAL": "capital equity kapital stammkapital grundkapital eigenkapital capitale capitaux",
    "PAIDIN": "paidin contributed subscribed paid eingezahlt* gezeichnet* libere libered apporte verse desembolsado desembolsada suscrito aportado versato gestort",
    "SHARE": "share shares stamm",
    # flows
    "EXPAND": "expansion expand expanding growth extension extensions new additional erweiterung erweiterungen ausbau neubau ampliacion ampliaciones expansion* ampliamento espansione uitbreiding",
    "REPLACE": "replacement replacements replace replacing renewal renewals renew renewing swap swapping ersatz erneuerung erneuerungen renouvellement* remplacement* renovacion renovaciones reposicion sustitucion sostituzione rinnovo vervanging",
    "OLD": "old worn aged ageing replacement replacing renewal renewals existing",
    "WORKS": "works capex capital investment investments build spend spending outlay investition investitionen travaux obra obras inversion inversiones investissement investissements investimenti lavori investering*",
    "DRAW": "drawdown drawdowns draw draws drawn drawing disbursement disbursements auszahlung auszahlungen abruf tirage tirages disposicion disposiciones desembolso desembolsos erogazione opname",
    "REPAY": "repayment repayments repay repaid redemption amortization amortizacion tilgung tilgungen ruckzahlung remboursement remboursements rembourse reembolso rimborso aflossing aflossingen back",
    "PRINCIPAL": "principal capital",
    "DIVIDEND": "dividend dividends distribution distributions payout payouts ausschuttung ausschuttungen dividende dividenden dividendes dividendo dividendos dividendi distribuci* uitkering",
    "DEBTSERVICE": "service dienst servicio servizio",
    "RESERVE": "reserve reserves reserved account rucklage rucklagen reserva reservas riserva riserve",
    "DEBT": "debt debts schuld schulden dette dettes deuda deudas debito debiti divida loan loans",
    # operations
    "VOLUME": "volume volumes output quantity quantities menge mengen quantite volumen volumenes cantidad quantita",
    "DELIVER": "delivered deliver deliveries supplied supply provided distributed abgegeben* geliefert* livre livree livres distribue* suministrad* entregad* fornit* erogata geleverd*",
    "RECEIVE": "received receive collected inflow inflows intake zufluss afflux erhalten percu percus percue recu recus recue recues recibido recibidos recibida ricevuti",
    "GENERATE": "generated generate generation produced production made output turbine erzeugt* erzeugung produktion produit produite production producida producido generada generado generacion prodotta produzione opgewekt*",
    "USE": "used use consumed consume consumption verbrauch verbraucht* consommation consommee consumo consumida consumido consumi verbruik",
    "SITE": "site own onsite eigen betrieb propio propia standort eigenverbrauch",
    "LENGTH": "length lengths lange langen longueur longueurs longitud longitudes lunghezza lengte",
    "SLUDGE": "sludge sludges biosolid biosolids schlamm schlamme klarschlamm boue boues lodo lodos fango fanghi slib",
    "REMOVE": "removed remove removal hauled haul hauling disposed disposal taken away abgefahren* abfuhr entsorgt* entsorgung evacue evacuee evacuees enleve enlevee enlevees retirado retirados retirada rimossi smaltiti afgevoerd*",
    "CARBON": "carbon co2 greenhouse kohlenstoff treibhaus carbone carbono invernadero serre efecto effet gas gases carbonio broeikas*",
    "EMIT": "emitted emission emissions output gas gases ausstoss emissionen emision emisiones emissioni uitstoot co2",
    # assumptions
    "INFLATION": "inflation inflacion teuerung teuerungs cpi consumer verbraucherpreis* verbraucher inflazione inflacao inflatie",
    "GROWTH": "growth increase rate rates wachstum croissance crecimiento crescita satz taux tasa tasso",
    "DISCOUNT": "discount discounting hurdle diskont diskontierung* actualisation descuento actualizacion sconto attualizzazione disconto",
    "RETURN": "return returns rendite rendement rentabilidad rendimiento rendimento",
    "REQUIRED": "required asked exige exigee exigido exigida gefordert* vereist*",
    "RATE": "rate rates satz satze rate raten taux tasa tipo tasso taxa",
    "MARGIN": "margin margins spread spreads marge marges margen margenes aufschlag margine margem",
    "BASE": "base basis",
    "LOSS": "loss losses leakage leakages leak leaks lost verlust verluste leck leckage perte pertes fuite fuites perdida perdidas fuga fugas perdita perdite perda* verlies*",
    "SHAREOF": "share anteil part",
    "TERM": "term terms tenor maturity duration time life laufzeit dauer duree plazo duracion durata prazo looptijd long lived",
    "REMAINING": "remaining left until rest verbleibend* restant restante residua end ends",
    "INTEREST": "interest interests zins zinsen interet interets interes intereses interessi juros rente",
    "FINANCE": "finance financing financial borrowing finanzierung financier financiere financiers financieros financiero finanziari*",
    # what makes another quantity of anything
    "OTHER": "date dates day days hour hours month months year years period periods quarter count counts number numbers ratio ratios factor flag flags switch index indices score scores status stage version counter age percentage average headcount method scenario reference change exchange currency datum stichtag tag tage jahr jahre monat anzahl quote faktor schalter kennzeichen zahler version wechselkurs nombre jour jours annee annees mois periode perioden ratio facteur drapeau indice interrupteur devise fecha dia dias ano anos mes meses numero cuenta proporcion bandera interruptor divisa cambio data giorno giorni anno anni mese mesi periodo indicatore bandiera aantal dag dagen jaar maand",
    "VALUE": "value values wert valeur valor valore",
}
#: Set phrases that say something else than their words do.
IDIOMS = {
    ("road", "user"): ("ROADUSER",), ("road", "users"): ("ROADUSER",), ("long", "term"): ("SENIOR",),
    ("bottom", "line"): ("NET", "RESULT"), ("working", "order"): ("MAINTAIN",), ("good", "order"): ("MAINTAIN",), ("good", "repair"): ("MAINTAIN",), ("running", "order"): ("MAINTAIN",),
    ("offentlichen", "hand"): ("PUBLIC",), ("offentliche", "hand"): ("PUBLIC",), ("a", "nouveau"): ("RETAIN",), ("carried", "forward"): ("RETAIN",), ("non", "distribues"): ("RETAIN",), ("not", "distributed"): ("RETAIN",),
    ("on", "hand"): ("BALANCE", "STOCK"), ("profit", "year"): ("NET", "RESULT"), ("state", "aid"): ("SUBSIDY", "PUBLIC"), ("real", "estate"): ("LAND", "PROPERTY"), ("bienes", "inmuebles"): ("LAND", "PROPERTY"),
    ("eaux", "usees"): ("SEWAGE", "WATER", "WASTE"), ("aguas", "residuales"): ("SEWAGE", "WATER", "WASTE"), ("acque", "reflue"): ("SEWAGE", "WATER", "WASTE"), ("working", "capital"): ("OTHER",), ("cash", "flow"): ("OTHER",), ("paid", "in"): ("PAIDIN",),
}
#: Words that only join others or say what holds of any figure.
JOINING = set(
    "a an and are as at be by for from has have in is it its of off on or our over per that the their they this to us we what when which with you your yet still not non no been will all any each yearly annual total amount amounts sum value values "
    "der die das des dem den ein eine einer und von vom zu zur zum im in aus auf fur mit bei an am uber je nach gesamt summe betrag "
    "le la les l un une du de des d et au aux a en sur par pour avec est dans total montant el los las lo del al y o por para con sin sobre su sus il lo gli i di da dei della delle degli del e per su o os as do dos das no na het een en van voor met op "
    "account accounts cuenta cuentas compte comptes konto konten line lines out up off down away other others autre autres otros otras andere altri".split()
)
_ENDINGS = re.compile(r"(?:s|es|e|n|en|er|em|r|x|i|a|o|os|as|d|ed)$")
#: Concepts that say only that a figure is paid, received or stands somewhere; a label may add them freely.
CARRIERS = frozenset({"PAY", "RECEIVE", "MONEY", "BALANCE"})
#: Letters per edit for unknown words, and the shortest word that may be misspelt.
LETTERS_PER_EDIT, MISSPELT_FROM = 5, 5
_WHO = [
    (re.compile(r"\b(?:owed|due|payable|owing) to us\b|\bthey owe us\b|\bowe us\b"), "RECEIVABLE CLIENT"),
    (re.compile(r"\bwe (?:still )?(?:owe|have not (?:yet )?paid|have to pay|must pay)\b"), "PAYABLE VENDOR"),
]


class Lexicon:
    """Concepts of words, with endings, compounds, joined words and misspellings; answers are kept."""

    def __init__(self, concepts: dict[str, str] = CONCEPTS, idioms: dict = IDIOMS, joining: set[str] = JOINING) -> None:
        self.exact: dict[str, set[str]] = defaultdict(set)
        self.stems: dict[str, set[str]] = defaultdict(set)
        for concept, words in concepts.items():
            for w in words.split():
                (self.stems if w.endswith("*") else self.exact)[w.rstrip("*")].add(concept)
        self.idioms, self.joining = {k: frozenset(v) for k, v in idioms.items()}, joining
        self.known: dict[str, tuple[str, list[frozenset[str]]] | None] = {}
        self.keys = sorted({*self.exact, *self.stems, *(w for k in idioms for w in k)})
        self.longest = max(map(len, self.keys), default=0)
        self.post: dict[str, list[int]] = defaultdict(list)
        for i, k in enumerate(self.keys):
            for g in grams(k):
                self.post[g].append(i)

    def plain(self, w: str) -> frozenset[str] | None:
        """Concepts of a word as written, or of what is left without an ending."""
        if w in self.exact:
            return frozenset(self.exact[w] | self.stems.get(w, set()))
        for cut in range(min(len(w), self.longest), max(3, len(w) - 7), -1):
            if w[:cut] in self.stems:
                return frozenset(self.stems[w[:cut]])
        m = _ENDINGS.search(w)
        if m and len(w) > 4:
            for k in (1, 2):
                if len(w) - k >= 4 and _ENDINGS.fullmatch(w[-k:]) and w[:-k] in self.exact:
                    return frozenset(self.exact[w[:-k]])
        return None

    def near(self, w: str) -> str | None:
        """The known word closest to a misspelt one; None if none is close or several are equally close."""
        if len(w) < MISSPELT_FROM:
            return None
        most = max(1.0, len(w) / LETTERS_PER_EDIT)
        shared: dict[int, int] = defaultdict(int)
        own = grams(w)
        for g in own:
            for i in self.post.get(g, ()):
                shared[i] += 1
        best, found = most, []
        for i, n in shared.items():
            k = self.keys[i]
            if len(k) < MISSPELT_FROM or n < 2 or abs(len(k) - len(w)) > most + (6 if k in self.stems else 0):
                continue
            if k in self.stems and len(k) < len(w):  # an ending of any letters: only the stem tells
                d = min(edit_cost(w[:cut], k, most) for cut in (len(k) - 1, len(k), len(k) + 1))
                if d > max(1.0, len(k) / (2 * LETTERS_PER_EDIT)):
                    continue
            d = min(edit_cost(w[:cut], k, best) for cut in {len(w), *((len(k) - 1, len(k), len(k) + 1) if k in self.stems else ())} if cut > 0)
            if d < best or d == best and d <= most:
                found = [*found, k] if d == best else [k]
                best = d
        means = {frozenset(self.exact.get(k, ())) | frozenset(self.stems.get(k, ())) for k in found}
        return found[0] if len(means) == 1 else None

    def parts(self, w: str, depth: int = 0) -> list[frozenset[str]] | None:
        """A compound or joined text as its words, the longest first; None if it is none."""
        for cut in range(min(len(w) - 3, self.longest + 6), 2, -1):
            head = self.plain(w[:cut])
            if head is None and w[:cut] not in self.joining:
                continue
            for link in ("", "s", "es", "n", "en"):
                rest = w[cut:]
                if not rest.startswith(link):
                    continue
                rest = rest[len(link) :]
                tail = [self.plain(rest)] if self.plain(rest) is not None else self.parts(rest, depth + 1) if depth < 5 and len(rest) > 5 else None
                if tail is not None:
                    return [*([head] if head else []), *tail]
        return None

    def misspelt_parts(self, w: str) -> list[frozenset[str]] | None:
        """A compound of which one half is misspelt."""
        if len(w) > 2 * (1.2 * self.longest + 6):  # longer than two words with endings and slips can be
            return None
        for cut in range(len(w) - 4, 3, -1):
            a, b = w[:cut], w[cut:]
            known = self.plain(b) if len(b) >= 5 else None
            if known is not None and (k := self.near(a)) and (m := self.plain(k)):
                return [m, known]
            known = self.plain(a) if len(a) >= 5 else None
            if known is not None and (k := self.near(b)) and (m := self.plain(k)):
                return [known, m]
        return None

    def spelt(self, w: str) -> bool:
        """Whether a word stands in the lexicon as it is written, alone or as a compound."""
        return w in self.joining or self.plain(w) is not None or any(w in k for k in self.idioms) or len(w) >= 6 and self.parts(w) is not None

    def word(self, w: str) -> tuple[str, list[frozenset[str]]] | None:
        """(the word as known, the concepts of its parts); None for a word nobody knows."""
        if w not in self.known:
            got: tuple[str, list[frozenset[str]]] | None = None
            if (p := self.plain(w)) is not None:
                got = (w, [p])
            elif any(w in k for k in self.idioms):
                got = (w, [])
            elif len(w) >= 6 and (ps := self.parts(w)) is not None:
                got = (w, ps)
            elif (k := self.near(w)) is not None:
                got = (k, [self.plain(k) or frozenset()] if self.plain(k) else [])
            elif len(w) >= 9 and (ps := self.misspelt_parts(w)) is not None:
                got = (w, ps)
            self.known[w] = got
        return self.known[w]

    def said(self, text: str, words: list[str]) -> list[frozenset[str]] | None:
        """The concepts of each word of a text that means anything; a word nobody knows is a concept of its own (``=word``)."""
        out: list[frozenset[str]] = []
        for pattern, concepts in _WHO:
            if pattern.search(text):
                out += [frozenset({c}) for c in concepts.split()]
        known = [(w if w in self.joining else (k := self.word(w)) and k[0] or w, w) for w in words]
        plain = [k for k, _ in known]
        core = [(i, k) for i, k in enumerate(plain)]
        i = 0
        while i < len(core):
            pair = (core[i][1], core[i + 1][1]) if i + 1 < len(core) else None
            skip = (core[i][1], core[i + 2][1]) if i + 2 < len(core) and core[i + 1][1] in self.joining else None
            far = (core[i][1], core[i + 3][1]) if i + 3 < len(core) and core[i + 1][1] in self.joining and core[i + 2][1] in self.joining else None
            hit = next(((n, self.idioms[p]) for n, p in ((2, pair), (3, skip), (4, far)) if p in self.idioms), None)
            if hit:
                out.append(hit[1])
                i += hit[0]
                continue
            w = known[core[i][0]][1]
            i += 1
            if w in self.joining:
                continue
            got = self.word(w)
            if got is None or not got[1]:
                out.append(frozenset({f"={got[0] if got else w}"}))
            else:
                out += got[1]
        return out
