"""Wordings written for measuring only: none stands in the tables or in any list of the library."""

NAMED = {
    "toll_income": ["toll revenue", "Mauterlöse", "proventi da pedaggi", "motorway tolls collected"],
    "water_sales": ["revenue from potable water", "Wassererlöse", "vendita di acqua"],
    "energy_sales": ["revenue from electricity", "Erlöse aus Stromverkauf", "vente de courant"],
    "connection_fees": ["hook-up fees", "Netzanschlussgebühren", "redevances de branchement"],
    "lease_income": ["rental income", "Pachterträge", "revenus locatifs", "ingresos por arrendamiento"],
    "grant_income": ["state aid received", "öffentliche Fördermittel", "subvenciones públicas"],
    "staff_cost": ["personnel expenses", "Personalkosten", "frais de personnel", "salaries", "Löhne und Gehälter"],
    "maintenance_cost": ["maintenance expense", "Wartungskosten", "frais d'entretien", "gastos de mantenimiento"],
    "energy_purchase": ["electricity purchased", "Stromeinkauf", "achat de courant"],
    "chemicals_cost": ["chemicals expense", "Kosten für Chemikalien", "coûts des réactifs"],
    "insurance_cost": ["insurance expense", "Versicherungskosten", "frais d'assurance", "seguros"],
    "land_levy": ["land tax", "property tax", "impôt foncier", "Grundabgaben"],
    "wear_charge": ["depreciation expense", "amortissements", "Abschreibung auf Anlagen", "depreciación"],
    "loan_interest": ["interest expense", "Darlehenszinsen", "intérêts d'emprunt", "interest paid on debt"],
    "company_tax": ["corporate income tax", "Ertragsteuern", "tax on company profits", "impuesto de la sociedad"],
    "net_result": ["net profit", "net income", "Nettoergebnis", "bénéfice net", "profit for the year"],
    "operating_result": ["operating profit", "operatives Ergebnis", "résultat opérationnel"],
    "client_balances": ["accounts receivable", "Kundenforderungen", "créances commerciales"],
    "vendor_balances": ["accounts payable", "Lieferantenverbindlichkeiten", "owed to suppliers"],
    "stores": ["inventory", "Lagerbestand", "stocks", "inventarios"],
    "bank_balance": ["cash at bank", "Bankguthaben", "solde bancaire"],
    "network_plant": ["network assets", "pipelines and pumps", "Rohrnetzanlagen"],
    "concession_right": ["concession rights", "droits de concession", "licence right"],
    "senior_loan": ["senior debt", "long-term debt", "bank borrowings outstanding"],
    "owner_loan": ["loans from shareholders", "prêt des associés", "Aktionärsdarlehen"],
    "deferred_tax": ["deferred taxes", "deferred tax liability", "passive latente Steuern"],
    "kept_surplus": ["retained earnings", "retained profits", "einbehaltene Gewinne", "bénéfices non distribués"],
    "paid_in_capital": ["share capital paid in", "contributed capital", "Stammkapital eingezahlt"],
    "growth_works": ["growth capex", "expansion investment", "Ausbauinvestitionen"],
    "renewal_works": ["replacement capex", "renewal investment", "Erneuerungsinvestitionen"],
    "loan_drawdown": ["loan draws", "Kreditauszahlung", "drawdown of loan", "tirage du prêt"],
    "loan_repayment": ["debt repayment", "repayment of principal", "Kredittilgung", "Rückzahlung des Darlehens"],
    "owner_payout": ["dividends", "distributions to shareholders", "Dividendenzahlung", "payout to shareholders"],
    "debt_reserve": ["debt service reserve account", "reserve for lenders", "Schuldendienstrücklage"],
    "water_volume": ["volume of water supplied", "gelieferte Wassermenge", "volume d'eau distribué"],
    "sewage_volume": ["wastewater treated", "volume of sewage", "Abwassermenge"],
    "power_generated": ["electricity generated", "Stromerzeugung", "production d'électricité", "energy produced"],
    "power_used": ["power consumption", "Stromverbrauch", "consumo de electricidad", "electricity used on site"],
    "mains_length": ["length of network pipes", "Rohrnetzlänge", "longitud de tuberías"],
    "sludge_mass": ["sludge disposed", "Schlammabfuhr", "boues enlevées"],
    "carbon_emitted": ["CO2 emissions", "carbon emissions", "Kohlenstoffemissionen", "emisiones de gases de efecto invernadero"],
    "water_tariff": ["price of water", "Wasserpreis", "tarif de l'eau"],
    "inflation": ["inflation rate", "CPI growth", "Inflationsrate", "inflación"],
    "hurdle_rate": ["required rate of return", "Diskontsatz", "taux de rendement exigé"],
    "loan_margin": ["margin on the loan", "Darlehensmarge", "spread over base rate"],
    "network_losses": ["losses in the network", "Leckverluste", "pérdidas en la red"],
    "concession_term": ["remaining concession term", "Konzessionsdauer", "remaining licence life"],
    "loan_tenor": ["loan term", "Kreditlaufzeit", "remaining life of the loan"],
}

NOTHING = [
    "number of employees", "interest cover", "loan covenant breach flag", "water pressure index", "share of leased vehicles", "count of customers", "inflation scenario switch", "toll booth number", "tax rate",
    "insurance claim count", "working capital", "opening balance", "cash flow", "pump efficiency", "concession start date", "maintenance crew size", "net debt to EBITDA", "gross margin", "units sold per visitor",
    "parking spaces", "dividend cover", "Anzahl der Mitarbeiter", "taux de change", "date de clôture", "legal fees", "marketing spend", "travel cost", "bad debt ratio", "electricity meter count", "sewage overflow events",
    "goodwill", "audit fees", "loan agreement number", "bank holiday flag", "Zinsdeckungsgrad", "nombre d'employés", "fecha de inicio de la concesión", "depreciation method", "salary increase factor", "stock exchange code",
    "power of attorney date", "land area", "surplus staff", "rent review interval", "reserve price at auction", "chemical plant visits", "pipe diameter", "network uptime", "carbon credit price", "sludge moisture",
]
