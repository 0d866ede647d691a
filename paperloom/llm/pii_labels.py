"""The small labelled table of the personal-information tagger.

Each row is a sentence or line, written for this project and not taken from any corpus; [a|b] is a choice, {name},
{family}, {phone}, {email}, {idnum} and {street} stand for labelled items, other slots for unlabelled fillers. Items
and fillers are made by rules with a fixed seed, and some words are replaced by words made up, so that the tagger
learns from shapes and the words around an item and not from sentences.
"""

from __future__ import annotations

import random
import re

KINDS = ("name", "phone", "email", "idnum", "address")

ROWS = """
[Zuständig|Verantwortlich|Unser Mann vor Ort|Ansprechpartner für Sie] ist [Herr|Frau|Herr Dr.|Frau Dr.] {name}[.| ({phone}).|, Tel. {phone}.|, Durchwahl {phone}.|, zu erreichen unter {phone}.|, mobil unter {phone}.]
[Herr|Frau] {family} [ruft|meldet sich] [morgen|nach dem Urlaub] [zurück|wieder]; [Nummer|erreichbar|Rufnummer][:| ist|] {phone}[.|]
[Bitte|Könnten Sie] [Herrn|Frau] {family} [zurückrufen|anrufen|verständigen][:| unter|, Telefon] {phone}[.|, am besten abends.]
[Wie|Was] mit [Herrn|Frau|Frau Dr.|Herrn Prof.] [{name}|{family}] [vereinbart|abgesprochen|verabredet], [kommt|geht] der Rest [später|am Montag].
[Abgeholt|Quittiert|Entgegengenommen|Geprüft|Gezeichnet|Übernommen] [von|durch] [Frau |Herrn ||]{name}[.| am {date}.|, Lager.]
[Unterzeichnet|Gez.|Bearbeiter|Sachbearbeiterin|Unterschrift|Name|Monteur|Fahrer|Kontakt|Empfänger][:| :] {name}
[Sachverständiger|Prüfer|Meister|Kollege|Kollegin|Vorarbeiter|Schichtleiter|Disponentin|Hausmeister|Zeuge] {name} [war|kommt|hat|sah] [dabei|alles|es heute][.| in der {street}.|, {street}.]
[Abzuladen|Zuzustellen|Montage|Einbau|Zustellung] [bei|für] {name}, {street}[.|, zweiter Stock.|, bitte klingeln.]
[Baustelle|Abholort|Neue Anschrift|Lieferort|Wohnhaft|Privat|Zustelladresse|Abladestelle|Treffpunkt][:| ist|] {street}[.|, Einfahrt {num}.|, Halle {num}.| in {town}.]
[Sie|Er] [wohnt|lebt|wartet] [jetzt|seit Mai|noch|] [in der|] {street}[.| in {town}.| bei {town}.]
[Kommen|Fahren|Liefern|Bringen] Sie [es|alles] [an die|zur|in die|an|statt dessen an] {street}[.|, Rampe {num}.|, Seiteneingang.]
[Steuer-ID|Steuernummer|Die IdNr.|Identifikationsnummer der Steuer][:| von ihm ist| lautet|] {idnum}[.|]
[Rentenversicherungsnummer|SV-Nummer|Die Versicherungsnummer der Kollegin|Sozialversicherungs-Nr.][:|] {idnum}[.|, Inhaber: {name}.|, auf den Namen {name}.]
[Ausweis|Ausweisnummer|Perso|Personalausweis Nr.|Reisepass Nr.|Pass|Reisepassnummer] {idnum} [wurde|haben wir] [kopiert|notiert|eingesehen|gezeigt].
[Schreiben Sie|Antwort bitte|Mail] [an|bitte an] {email}[.| oder rufen Sie {phone} an.| bzw. Tel. {phone}.]
[Belege|Unterlagen|Eine Abschrift von {ref}|Fotos|Scans] [gehen|bitte] an {email}[.| schicken.| senden.]
[Funk|Handy|Mobil|Mobiltelefon] {phone}[,| /] [Fax|Telefax|Festnetz] {phone}
[Telefon|Fon|Tel|Tel.|T|Telefax|Fax|Mobil|Notruf|Zentrale|T.|F|M][:|] {phone}[| , Fax {phone}| \\| {email}| \\| Fax {phone}]
[E-Mail|Mail|Web-Kontakt|e-mail][:|] {email}
{email}
{phone}
{phone} \\| {email}
[z. Hd.|z.H.|zu Händen|c/o|Attention|Attn|Attn:|A l'attention de|Para|F.A.O.] {name}
[Von|An|Kopie|Cc|From|To|De|Para|À][:| :] {name} <{email}>
[Sehr geehrter|Lieber|Werter|Guten Tag|Hallo|Moin] Herr {family}[,|]
[Sehr geehrte|Liebe|Werte|Guten Tag|Hallo|Moin] Frau [Dr. |Prof. |]{family}[,|]
[Hallo|Lieber|Liebe|Hi|Servus] {name},
[Please ask for|The man to talk to is|Our agent is|You will be met by|Account manager:|Your point of contact:] [Mr|Mrs|Ms|Miss|Dr] {name}[.|, tel. {phone}.|, mobile {phone}.| on {phone}.| (phone {phone}).]
[Mr|Mrs|Ms|Dr] {family} [rang|called|phoned] and [wants|asks] a call [on|back on|at] {phone}[.| before noon.| tonight.]
[As discussed with|According to|Further to my talk with|As settled with] [Mr |Ms |Mrs ||]{name}, the [rest|missing {num}] [is cancelled|follows].
[Taken|Signed|Checked|Collected|Received|Unloaded|Witnessed] by [Mr |Mrs |Ms ||]{name}[.| on {date}.| at the gate.]
[Technician|Driver|Surveyor|Inspector|Foreman|Colleague|Clerk|Witness|Worker] {name}[, tax number {idnum},|, ID {idnum},|] [was|came|left] [there|early|on {date}][.| with {amount} EUR.]
[He|She] [lives|stays|is waiting] at {street} [near|in|by] {town}[.|]
[Bring it|Ship this|Unload|Drop it|Send everything] [to|at] {street}[.|, gate {num}.|, dock {num}.| instead.]
[New address|Site|Pick-up|Drop-off|Home address][:| is] {street}[.|, rear door.]
[NI number|National Insurance no.|Social security no.|Insurance number of the fitter|Tax ID|Taxpayer number][:| is|] {idnum}[.|]
[Passport no.|Passport number|ID card|Identity card|Driver's ID] {idnum} [was|has been] [copied|noted|checked|seen][.| at the gate.]
[Write to|Mail|Reach us at|Send queries to|Copies of {ref} go to] {email}[.| or dial {phone}.| or call {phone}.]
[Phone|Telephone|Cell|Mobile|Call|Fax|Ph.|Tel][:|] {phone}
Dear [Mr|Mrs|Ms|Miss|Dr] {family}[,|:]
[Dear|Hi|Hello] {name},
[Demandez|Votre contact :|La personne en charge est|Vous pouvez joindre] [M.|Mme|Monsieur|Madame] {name}[.|, tél. {phone}.| au {phone}.| ({phone}).]
[M.|Mme|Monsieur|Madame] {family} [attend|souhaite|voudrait] un appel au {phone}[.| ce soir.]
[Reçu|Signé|Retiré|Contrôlé|Remis] [par|à] [M. |Mme ||]{name}[.| le {date}.| hier soir.]
[Comme vu avec|D'accord avec|Selon] [M. |Mme ||]{name}, le reste [suivra|est annulé].
[Livrez au|Nouvelle adresse :|Chantier :|Venez au|Il habite|Déposez tout au] {street}[.|, porte {num}.|, entrepôt {num}.]
[N° de sécurité sociale|Numéro fiscal|No d'assuré|Sécu][ :| de l'ouvrier :|] {idnum}[.|]
[Passeport|Carte d'identité|Pièce d'identité n°|CNI] {idnum} [vue|copiée|relevée][.| le {date}.]
[Un courriel à|Répondez à|Contact :|Envoyez-le à] {email}[.| suffit.]
[Tél.|Téléphone|Portable|Fax][ :|] {phone}
[Cher|Chère|Bonjour] [Monsieur|Madame] {family},
[Pregunte por|Su gestor es|Le atiende|Hable con] [el señor|la señora|D.|Dña.|don|doña] {name}[.|, tel. {phone}.|, móvil {phone}.| en el {phone}.]
[El señor|La señora|Sr.|Sra.] {family} [espera|quiere|desea] una llamada al {phone}[.| hoy.]
[Recibido|Firmado|Retirado|Revisado] por [el señor |la señora ||]{name}[.| el {date}.]
[La caja|El envío|Todo] [se dio|quedó] [a|con] {name}[.| ayer.]
[Entreguen en|Obra:|Vive en|Dirección nueva:|Lleven todo a] {street}[.|, nave {num}.|, puerta {num}.]
[DNI|NIE|DNI del montador:|N.º de la Seguridad Social|Pasaporte|Documento de identidad][ n.º|:|] {idnum}[.| visto el {date}.]
[Escriba a|Respuestas a|Correo:|Mande copia a] {email}[.| por favor.]
[Tel.|Teléfono|Móvil|Fax][:|] {phone}
[Estimado|Querido|Apreciado] [señor|Sr.] {family}[:|,]
[Estimada|Querida|Apreciada] [señora|Sra.] {family}[:|,]
{W} {w} {w} {name} {w} {w}[.|, {w} {W}.]
{W} {w} {w} {W} {w} {name}[.| {w} {w}.| ({w} {w}).|, {w} {num}.]
{W} {name} {w} {w} {w} {W} {w} {w}.
[Herr|Frau|Mr|Mrs|Ms|Mme|M.|Madame|El señor|La señora] {family} {w} {w} {w} {W} {w} {w}.
[Herr|Frau|Mr|Mrs|Ms|Mme|M.|Monsieur|El señor|La señora] {family} {w} {w} {w} {w} {phone} {w} {w}.
[Mme|M.|Herr|Frau|Mr|Ms] {family} {w} {w} {w} {w} {w} {phone}.
{W} {w} {w} {w} [Mme|M.|Herrn|Frau|Mr|Ms|señor] {name} {w} {w}.
{W} {w} {w} [by|von|par|por|with|mit|avec|con|a|to|an|à|für|for|de] {name}[ on {date}.| {w} {w}.| am {date}.|, {w} {w} {w} {num} {w} {w}.| en {w}.]
{W} {w} [by|von|par|por|with|mit|avec|con|a|to|an|à|für|for|de] {name}[ on {date}.| {w} {w}.| am {date}.|, {w} {w} {w} {num} {w} {w}.| en {w}.]
{W} {w} {w} [in der|an der|zur|at|to|au|en|in|laut {W}] {street} {w} {w}[.| {town}.|, {w} {num}.]
{W} {w} {w}[:| :] {street}, {w} {num}.
{W}versicherungsnummer {idnum}, {W} {w} {W}: {name}.
{W} {w} {w} {w} {w} {W} {phone} {w} {w} {w}.
{W} {w} [Nummer|number|teléfono|numéro|Telefon|phone] {phone}[.| {w} {w} {w}.]
{W} {w} {w} {W} {w} {w} [Herrn|Herr|Frau|Mr|Ms|Mrs|Mme|M.|señor|señora] [{name}|{family}] {w} {w} {W}.
{W} [Frau|Herrn|Mr|Mme] {family} {w} {w}.
{W} {w} {w} {w} {street} {w} {w} {w}.
{W} {w} {W} {street}[.| {w} {town} {w}.|, {w} {W} {num}.|, {W}, {W} {num}.]
{W} {w} {w} {w} {street} {w} {town}[.|, {w} {w}.]
{W} {w} {w} {phone} {w} {w}.
{W} {w} {w} {w} {W} {phone}[.| {w} {w} {w}.]
{W} {w} {W} {w} {email} {w} {w} {w}.
{W} {w} {w} {w} {w} {email}[.| {w} {w} {phone}.]
{W} {w} [Ausweis|Reisepass|Passport|DNI|passeport|Steuernummer|Versicherung] {w} {idnum} {w} {w} {w}.
{W}[nummer|ausweis|pass|-Identifikationsnummer|versicherungsnummer] {w} {W} {w} {idnum}[.|, {W} {w} {W}: {name}.]
{W} {name}, {w} {w} {idnum}, {w} {w} {amount} EUR {w}.
{W} {w}: {name}
{W} {W}: {name}
{W} {w}: {street}[.|, {W}, {W} {num}.]
{W} {w}: {email}
{W} {w}: {phone}
""".strip().split("\n")

#: Rows without any personal information.
NEGATIVE = """
{W} {w} {w} {W} {w} {w} {date} {w} {W}.
{W} {w} {num} {W} {w} {W} {w} {w} {w} {W}.
{W} {w} {w} {ref} {w} {w} {amount} EUR {w} {W} {W} {w}.
{W} {W} {w} {w} {w} {W} {w} {W} {town} {w}.
{W} {w} {w} {num} {w} {W} {w} {w} {W} {num} {w}.
{W} {w} {W} {ref} {w} {w} {w} {date} {w} {w} {W}.
{W} {W}, {W} {num}, {W} {num}, {w} {W} {ref} {w}.
{w} {noun} {w} {num} {w} {w} {noun} {w} {town}.
{W}
{W} {W}
{W} {W} {ref}
{W} {ref}
{W} {W} {ref}, {w} {w} {date}
[Der|Dieser|Jeder] {noun} [ist|war|bleibt] [seit|ab] {date} [lieferbar|vergriffen|im Zulauf], [Menge|Bestand] {num} [Stück|Kisten].
[Ihr|Unser] [Auftrag|Schreiben|Angebot|Beleg] {ref} [liegt|ging] [hier|am {date} ein|uns vor]; [Wert|Summe|Preis] {amount} EUR.
[Fracht|Zoll|Porto|Maut] nach {town} [zahlt|übernimmt] [der Besteller|die Werft], [siehe|gemäß] {ref}.
[Mängel|Schäden|Fehlmengen] [am|beim] {noun} [melden|zeigen] Sie [bitte|uns] [sofort|binnen {num} Tagen] [an|schriftlich].
[Die|Eine] Zahlung [von|über] {amount} EUR [fehlt|steht aus|kam doppelt]; [Frist|Ziel]: {date}.
[Wir|Die Kollegen] [danken|bitten] [herzlich|sehr] und [warten|hoffen] auf [Nachricht|Antwort|Freigabe].
[Das|Ein] Protokoll {ref} [nennt|zeigt] {amount} [bar|Volt|Grad|Ohm] bei {num} [Messungen|Proben|Läufen].
[Wartung|Umbau|Abnahme|Eichung] [der Anlage|des {noun}] [am|ab dem|erst am] {date}, [Dauer|Aufwand] {num} [Stunden|Tage].
[Palette|Karton|Gebinde|Behälter|Fach|Regal|Gang|Tor|Rampe] {num} [ist|war] [leer|voll|nass|versiegelt], [Los|Plombe] {n6}.
[Eigentum|Rechte|Skonto|Rabatt|Garantie] [gehen|geht|gilt|gelten] [erst|nur] [nach|bei] [Ausgleich|Abnahme] [über|von] {amount} EUR.
[Fahrzeug|Stapler|Kran|Wagen] {ref} [braucht|bekam] [neue|andere] [Reifen|Bremsen|Kette] und [Öl|einen {noun}].
[Abteilung|Team|Gruppe] [Einkauf|Technik|Verkauf|Personal|Versand] [hilft|antwortet] [werktags|täglich] gern.
[Bestellen|Zahlen|Prüfen] Sie [bitte|noch] {num} {noun} [je|zu] {amount} EUR.
[Muster|Typ|Serie|Modell] {ref} [passt|fehlt|läuft aus], [Ersatz|Nachfolger] ist {noun}.
[KW|Kalenderwoche|Woche] {num}: [Anlieferung|Versand|Ausfall] [in|ab] {town}.
[Gewicht|Volumen|Maß] [brutto|netto] {amount} [kg|t|m³], [verteilt|gepackt] auf {num} [Colli|Paletten].
[Die|Jede] Meldung [zum|über den] {noun} [vom|am] {date} [betraf|nannte] {num} Teile [aus|von] {town}.
[Invoice|Order|Offer|Claim] {ref} [of|from] {date} [totals|stands at] {amount} EUR [net|gross|before tax].
[Every|Each|No] {noun} [was|is] [tested|packed|sealed] [at|in] {town} on {date}.
[Payment|Cash|Settlement] [within|after] {num} days [earns|means] {amount} percent [off|discount].
[Goods|Parts|Crates] [stay|remain] ours [until|till] [paid|cleared] in full.
[We|They] [will|shall] [ship|replace|send] {num} [pieces|boxes|units] [from|via] {town} in week {num}.
[Report|Drawing|Log] {ref} [shows|lists|gives] {amount} bar [twice|again|on {date}].
[Service|Upkeep|Repair] of the {noun} [takes|costs] {num} [hours|days] or {amount} EUR.
[Kindly|Please] [confirm|note|check] [the date|our claim|this list] [by|before] {date}.
[Le|Chaque|Un] {noun} [est|reste] [prêt|en stock|épuisé] [depuis|dès] le {date}.
[Facture|Commande|Avis] {ref} du {date} : {amount} EUR [hors taxe|net|à payer].
[Les|Vos] {num} [caisses|palettes|pièces] [partent|viennent] de {town} [demain|le {date}].
[Un|Le] rabais de {amount} pour cent [vaut|joue] dès {num} [achats|lots].
[Merci|Prière] de [payer|régler|vérifier] [avant|sous] {num} jours.
[Rapport|Plan|Relevé] {ref} : {amount} bar [mesurés|lus] le {date}.
[El|Cada|Un] {noun} [está|queda] [listo|agotado|en camino] [desde|para] el {date}.
[Pedido|Factura|Aviso] {ref} del {date}: {amount} EUR [netos|a pagar].
[Salen|Llegan] {num} [cajas|bultos|piezas] de {town} [mañana|el {date}].
[Un|El] descuento del {amount} por ciento [vale|rige] desde {num} [lotes|piezas].
[Paguen|Revisen] [antes|dentro] de {num} días, [gracias|por favor].
[Acta|Plano|Ficha] {ref}: {amount} bar [leídos|medidos] el {date}.
[Eingang|Erhalten|Gesehen|Kopie|Duplikat|Received|Copy|Reçu|Recibido|ENTWURF|STORNO][:| ] {date}
[Blatt|Scan|Vorgang|Stapel|Archiv|geprüft|gebucht|erledigt|paid|bezahlt|freigegeben][-Nr.|] {n6}
[Warennummer|Customs code|Code douanier|Zollcode|Tarif][:|] {tariff}[|, Herkunft EU|, origin EU]
[UID|USt-ID|Umsatzsteuer-ID|VAT reg.|VAT no.|TVA|CIF|NIF empresa|Company reg.][:|] [DE{n9}|GB{n9}|FR{n2} {n9}|B{n8}|{n8}][|, HRB {n5} {town}|, Registergericht {town} HRB {n5}|, company no. {n8}|, Reg. {n8}]
[Konto|IBAN|Bankverbindung][:|] [DE{n2}|FR{n2}|ES{n2}] {n4} {n4} {n4} {n4} {n2}[|, BIC {upper}DE{n2}XXX| BIC {upper}DEFFXXX]
[Art.|Artikel|Item|Ref|Réf|Teil|Sach-Nr.|Artikelnummer][:| |-Nr. ] {n4}-{n3}-{n2}[|, Charge {n6}|, lot {n6}|, batch {n6}|, Los {n6}]
[Plan|Zeichnung|Drawing|Skizze|Plano|Dessin] {n3}/{n4}[| Blatt {n2}| sheet {n2}| rev. {n1}]
[Format|Größe|Maße|Size|Dim.] {n2} x {n3}[| x {n2}] [mm|cm][|, {n2} St. @ {amount}|, {n2} pcs @ {amount}]
{n2} [Stück|pcs|St.|uds|pièces] @ {amount}[| each| je Stück][|, drawing {n3}/{n4}|, Zeichnung {n3}/{n4}]
[Postfach|P.O. Box|PO Box|Boîte postale|Apartado|BP] {n4}[|, {n5} {town}]
  {n1}  {noun}  {n3}.{n4}  {n2}  {amount}
  {num}  {noun} {noun}  {n3},{n2}  {n3}  {amount}
Pos. {num}: {noun}, {num} Stück, {amount} EUR
{n5} {town}
{firm}
{firm}
{firm}
[an|von|bei|für|mit] {firm} [gesendet|geliefert|vereinbart].
[The|Our] [buyer|partner|client] {firm} [agrees|pays].
[Beleg|Rechnung|Gutschrift|Bericht|Notiz|Mahnung|Lieferschein|Angebot|Beschwerde|Auftrag] [Nr.|Nummer:|Vorgang|-|#] {ref}[  |   | , ][vom|Datum:|Stand|erstellt am] {date}
[Invoice|Note|Claim|Report|Reminder|Order|Statement] [No.|number:|ref.|#] {ref}[  |   | , ][dated|issued|date:|Date:|of] {date}
[Facture|Avoir|Bon|Relance|Rapport|Commande] [n°|Réf.|no] {ref}[  |   | , ][du|Date :|le] {date}
[Factura|Albarán|Abono|Informe|Aviso|Pedido] [n.º|Ref.|núm.] {ref}[  |   | , ][Fecha:|del] {date}
[AW|Re|WG|Fwd|TR|RV|Betreff|Subject|Objet|Asunto]: [Rechnung|Mahnung|Order|Note|Facture|Pedido|Bericht|Report|Notiz] {ref}
[Geehrte|Sehr geehrte|Liebe|Werte] [Damen und Herren|Kundschaft|Kolleginnen und Kollegen|Partner],
[Hallo|Guten Tag|Guten Morgen|Moin|Servus|Hello|Hi all|Good day|Good morning|Bonjour|Bonsoir|Buenos días|Buenas tardes][,|:|]
Dear [Sir or Madam|Sirs|Customer|all|Team],
[Madame, Monsieur|Mesdames, Messieurs|Chers partenaires|Chers clients],
[Muy señores míos|Estimados señores|Estimados clientes|Apreciados señores]:
[Mit freundlichen|Mit besten|Freundliche|Viele|Beste|Herzliche] [Grüßen|Grüße]
[Best|Kind|Warm] [regards|wishes]
[Yours|Sincerely|Faithfully] [sincerely|truly|yours|faithfully]
[Cordialement|Bien à vous|Salutations|Salutations distinguées|Saludos|Atentamente|Un saludo|Cordialmente]
[Einkauf|Verkauf|Vertrieb|Technik|Personal|Werk Nord|Versand|Lager|Buchhaltung|Werkstatt|Disposition|Kasse]
[Sales|Stores|Billing|Purchasing|Accounts|Office|Dispatch|Yard|Warehouse|Workshop]
[Achats|Ventes|Atelier|Dépôt|Comptabilité|Expédition|Ventas|Compras|Almacén|Taller|Contabilidad|Envíos]
""".strip("\n").split("\n")

# Common given names of four languages.
GIVEN_NAMES = """
Alexander Andreas Anja Annette Bernd Birgit Carola Christoph Daniela Dirk Elke Erika Florian Frank Gisela Günter Hannelore Helga Holger Ingrid Joachim Jonas Jörg Karin Klaus Lars Lena Manfred Marlene
Markus Nadine Norbert Ralf Renate Rolf Sandra Silke Stefan Tanja Ulrike Uwe Volker Wolfgang Yvonne Änne Ömer Aylin Mehmet Fatma Alan Amy Barry Brian Carol Colin Diane Elaine Emma Geoffrey Graham Helen Ian
Janet Keith Laura Malcolm Nigel Pamela Rachel Simon Stuart Tracy Vikram Wayne Anne-Marie Benoît Cédric Chloé Denis Élodie Fabien François Hélène Jean-Paul Julien Laurent Lucie Marc-Antoine Nathalie Olivier
Sébastien Sylvie Yves Alberto Álvaro Ángela Carmen Diego Elena Fernando Gonzalo Inés Javier Lucía Manuel Núria Óscar Ramón Sofía Teresa Vicente Hans-Jürgen Karl-Otto Eva-Maria Ann-Kathrin
""".split()
_ONSET = "B Br D Dr F Fl G Gr H J K Kl Kr L M N P Pf R S Sch Schm Schw Sp St T Tr V W Z C Ch Cl Sh Th".split()
_NUCLEUS = "a e i o u ä ö ü ei au ie a e o i u oo ea".split()
_CODA = "b ck ff g ll lt m mm n nn nd ng pp r rk rt s ss tt tz x nz ld lm".split()
_TAIL = "er mann el en ke le ig lich ert ner ler old ow ski ek ing ham ley son ford er ez era ado ier ard et elle in os a o e y stein bach hof wald burg heim haus brink egg mayr huber feld berg".split()
_STEM = "Acker Anger Birken Buchen Eichen Erlen Färber Feld Finken Fischer Garten Gruben Heide Hirten Holunder Kasernen Kloster Krähen Lerchen Markt Post Ring Schiller Schul Sonnen Stein Tal Tannen Ufer Wiesen Ost Nord".split()
_SAINT = "Chênes Fontaines Jardins Marronniers Meuniers Peupliers Prés Vignes Roses Forges".split()
_CALLE = "Olivos Naranjos Mayor Fuente Iglesia Herrería Ronda Pinos Mercado Telares".split()
_ROADS = "Abbey Baker Castle Dale Elm Ferry Garden Harbour King Lower Meadow Oak Park River School Tower Upper Willow".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _made(r: random.Random, parts: int = 2) -> str:
    return "".join(r.choice(_ONSET).lower() + r.choice(_NUCLEUS) + r.choice(_CODA) for _ in range(parts))


def family(r: random.Random) -> str:
    f = (r.choice(_ONSET).lower() + r.choice(_NUCLEUS) + (r.choice(_CODA) if r.random() < 0.7 else "") + (r.choice(_NUCLEUS) + r.choice(_CODA) if r.random() < 0.25 else "") + r.choice(_TAIL)).capitalize()
    return f"{f}-{_made(r, 1).capitalize()}" if r.random() < 0.04 else f


def name(r: random.Random) -> str:
    g, f = r.choice(GIVEN_NAMES) if r.random() < 0.55 else _made(r, 1).capitalize() + r.choice(["a", "e", "o", "us", "in", "ine", "", "y", "el", "ert", "ard", "ía", "ette"]), family(r)
    t = r.random()
    if t < 0.1:
        return f"{f}, {g}"
    if t < 0.2:
        return f"{g[0]}. {f}"
    if t < 0.27:
        return f"{g} {r.choice(['von', 'van', 'de', 'de la', 'zu', 'von der', 'del', 'du'])} {f}"
    if t < 0.35:
        return f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}. {f}"
    return (f"{g} {f}").upper() if t < 0.44 else f"{g} {f}"


def phone(r: random.Random) -> str:
    """A country or trunk prefix, an area code and a number, in groups or not."""
    sep = r.choice([" ", "-", "/", ".", " - ", " ", ""])
    left = r.randint(5, 8)
    if r.random() < 0.45:  # in groups
        inner, groups = r.choice([" ", " ", ".", "-"]), []
        size = r.choice([2, 3, 2, 4])
        while left > 0:
            groups.append(_digits(r, min(size if left - size != 1 else size + 1, left)))
            left -= len(groups[-1])
        number = inner.join(groups)
    else:
        number = _digits(r, left) + (f"{sep if sep in ('.', '-') else '-'}{_digits(r, r.randint(1, 4))}" if r.random() < 0.35 else "")
    area = _digits(r, r.randint(1, 4))
    t = r.random()
    if t < 0.3:
        return r.choice(["0{a}{s}{n}", "0{a}{s}{n}", "(0{a}) {n}", "0{a}/{n}", "0{a} - {n}"]).format(a=area, s=sep or " ", n=number)
    if t < 0.6:
        c = r.choice(["49", "49", "33", "34", "44", "43", "41", "1"])
        return r.choice(["+{c} {a} {n}", "+{c}{a}{m}", "+{c} (0) {a} {n}", "00{c}-{a}-{n}", "00{c} {a} {n}", "+{c}-{a}-{n}", "+{c} (0){a} {n}", "+{c} {a}/{n}"]).format(c=c, a=area, n=number, m=re.sub(r"\D", "", number))
    if t < 0.64:
        return f"0{_digits(r, r.choice([3, 4]))} {_digits(r, r.choice([5, 6, 7]))}"
    if t < 0.68:
        i, j = r.choice([" ", "-"]), r.choice([" ", "-", " "])
        c = r.choice(["00", "+"]) + r.choice(["34", "33", "49", "44"])
        return c + i + r.choice([j.join(_digits(r, 3) for _ in range(3)), j.join([_digits(r, 1), *[_digits(r, 2) for _ in range(4)]]), j.join([_digits(r, 2), _digits(r, 4), _digits(r, 4)])])
    if t < 0.76:
        i = r.choice([" ", ".", "-", " "])
        return i.join([r.choice(["0", "0"]) + _digits(r, 1), *[_digits(r, 2) for _ in range(4)]])
    if t < 0.86:
        i = r.choice([" ", "-", " ", " ", "."])
        return i.join([r.choice("67899") + _digits(r, 2), *r.choice([[_digits(r, 3), _digits(r, 3)], [_digits(r, 2), _digits(r, 2), _digits(r, 2)]])])
    if t < 0.92:
        return r.choice(["({}) {}-{}", "{}-{}-{}", "+1-{}-{}-{}", "+1 ({}) {}-{}"]).format(_digits(r, 3), _digits(r, 3), _digits(r, 4))
    return f"0{_digits(r, r.choice([2, 3]))} {_digits(r, 4)} {_digits(r, r.choice([3, 4]))}"


def idnum(r: random.Random) -> str:
    letter = lambda: r.choice("ABCDEFGHJKLMNPRSTXYZ")
    s = r.choice([" ", " ", "", "-", "/", ""])
    kind = r.randrange(8)
    if kind == 0:  # taxpayer, eleven digits
        return s.join([_digits(r, 2), _digits(r, 3), _digits(r, 3), _digits(r, 3)]) if s != "/" else s.join([_digits(r, 3), _digits(r, 4), _digits(r, 4)])
    if kind == 1:  # insurance of employees
        return s.join([_digits(r, 2), _digits(r, 6), letter(), _digits(r, 3)])
    if kind == 2:  # identity card or passport
        return letter() + _digits(r, 2) + letter() + _digits(r, 2) + letter() + _digits(r, 2) if r.random() < 0.6 else letter() + _digits(r, 8)
    if kind == 3:  # two letters, six digits, one letter
        return s.join([letter() + letter(), _digits(r, 2), _digits(r, 2), _digits(r, 2), letter()])
    if kind == 4:  # eight digits and a letter, or a letter, seven digits and a letter
        return (_digits(r, 8) if r.random() < 0.7 else r.choice("XYZ") + _digits(r, 7)) + r.choice(["", "-", " "]) + letter()
    if kind == 5:  # sex, year, month, place
        return s.join([r.choice("12"), _digits(r, 2), _digits(r, 2), _digits(r, 2), _digits(r, 3), _digits(r, 3), _digits(r, 2)])
    if kind == 6:
        return "-".join([_digits(r, 3), _digits(r, 2), _digits(r, 4)])
    return _digits(r, r.choice([9, 11, 10, 12]))


def email(r: random.Random) -> str:
    g, f = r.choice(GIVEN_NAMES).lower().replace("-", ""), family(r).lower().translate(_ASCII)
    user = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}{_digits(r, 2)}", f, f"{g[0]}.{f}", r.choice(["info", "office", "kontakt", "hello", "service"]), f"{g}+{_made(r, 1)}", f"{g}_{f}", f"{f}-{g}"])
    host = r.choice(["", "", "mail.", "mx.", "post."]) + _made(r, r.choice([1, 2])).translate(_ASCII) + r.choice(["", "", "-gmbh", "-group", "24", "-werke"])
    end = r.choice(["example", "invalid", "test", "de", "com", "org", "net", "fr", "es", "co.uk"])
    if r.random() < 0.65:
        e = f"{user}@{host}.{end}"
        return e.upper() if r.random() < 0.06 else e
    word = r.choice(["at", "AT", "ät"])
    at = r.choice([f" ({word}) ", f" [{word}] ", f"({word})", f"[{word}]", f" {word} ", " @ ", "@ ", " @", "{" + word + "}"])
    word = r.choice(["dot", "punkt", "DOT", "point"])
    dot = "." if "@" in at or r.random() < 0.4 else r.choice([f" [{word}] ", f" ({word}) ", f"[{word}]", f"({word})", f" {word} "])
    return f"{user}{at}{host.replace('.', dot)}{dot}{end}"


_ASCII = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "é": "e", "á": "a", "í": "i", "ó": "o", "ç": "c"})


def street(r: random.Random) -> str:
    n = str(r.randint(1, 240)) + r.choice(["", "", "", "", r.choice("abcdef"), " " + r.choice("abcdef"), " " + r.choice("abcdef"), f"-{r.randint(2, 240)}", f"/{r.randint(1, 9)}"])
    t = r.random()
    if t < 0.55:
        b = r.choice(_STEM) if r.random() < 0.7 else _made(r, 1).capitalize() + r.choice(["er ", "en", "s", ""])
        b = b.strip()
        s = r.choice([f"{b}straße", f"{b}straße", f"{b}strasse", f"{b}str.", f"{b} Straße", f"{b} Str.", f"{b}-Straße", f"{b}weg", f"{b}allee", f"{b}-Allee", f"Alte {b}gasse", f"Am {b}berg", f"Am {b}graben", f"An der {b}mühle", f"An der {b}brücke", f"Im {b}winkel", f"{b}gasse", f"{b}platz", f"{b}ring", f"Zum {b}hof", f"{b}damm", f"{b}ufer", f"Neuer {b}weg"])
        if r.random() < 0.12:
            s = s.upper().replace("ß", "SS")
        return f"{s} {n}"
    if t < 0.7:
        return f"{n} {r.choice(_ROADS) if r.random() < 0.7 else _made(r, 1).capitalize()} {r.choice(['Road', 'Lane', 'Close', 'Row', 'St.', 'Street', 'Way', 'Avenue', 'Ave.', 'Rd.', 'Drive', 'Court'])}"
    if t < 0.85:
        p = r.choice([f"des {r.choice(_SAINT)}", f"de la {_made(r, 1).capitalize()}e", f"du {_made(r, 1).capitalize()}", f"de {_made(r, 1).capitalize()}"])
        return f"{n}{r.choice([',', '', ' bis,', ' ter,'])} {r.choice(['rue', 'chemin', 'avenue', 'boulevard', 'impasse', 'place', 'quai', 'allée'])} {p}"
    q = r.choice(_CALLE) if r.random() < 0.7 else _made(r, 1).capitalize() + "os"
    return f"{r.choice(['Avda. de los', 'Avda.', 'Calle', 'Calle de', 'Calle del', 'C/', 'Paseo de', 'Paseo del', 'Plaza', 'Plaza de', 'Camino de', 'Ronda de'])} {q}{r.choice([',', '', ''])} {n}"


def _plain(r: random.Random, slot: str) -> str:
    if slot[0] == "n" and slot[1:].isdigit():
        return _digits(r, int(slot[1:]))
    if slot in "wW":
        w = _made(r, r.choice([1, 1, 2, 2, 3]))
        w = r.choice([w, w, w[: r.randint(2, 4)], w + r.choice(["en", "e", "t", "ung", "ed", "s", "es", "er", "keit", "ción", "ment", "ent", "os", "lich", "te"])])
        return w if slot == "w" else (w + r.choice(["", "", "ung", "en", "heit", "nummer", "termin", "stück", "e"])).capitalize()
    if slot == "num":
        return str(r.randint(1, 120))
    if slot == "upper":
        return _made(r, 1).upper()[:4]
    if slot == "ref":
        return r.choice(["", "", f"{_made(r, 1).upper()[:2]}-", r.choice("ABCKTXZ"), f"{_digits(r, 2)}/", "B-"]) + _digits(r, r.randint(5, 9))
    if slot == "date":
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(2015, 2029)
        word = r.choice(["Januar", "Mai", "August", "Dezember", "May", "August", "November", "juin", "août", "mars", "de mayo de", "de enero de", "de julio de"])
        return r.choice([f"{d:02d}.{m:02d}.{y}", f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d}/{m}/{y}", f"{d}. {word} {y}", f"{d} {word} {y}", f"{d:02d}.{m:02d}.{y % 100:02d}"])
    if slot == "town":
        return r.choice([_made(r, 1).capitalize() + r.choice(["ingen", "heim", "stedt", "au", "ford", "ville", "burg", "dorf", "ow", "itz", "bach", "furt", "a"]), _made(r, 2).capitalize()])
    if slot == "noun":
        w = _made(r, r.choice([1, 2]))
        return r.choice([w.capitalize() + r.choice(["rohr", "ventil", "blech", "platte", "schraube", "motor", "lager", "riemen", "filter", "kasten", "profil", "scheibe", "handschuhe", "schlauch", "pumpe", "waage"]), f"{w} {_made(r, 1)}", f"{_made(r, 1)} {r.choice(['valve', 'pump', 'belt', 'bar', 'gear', 'à vis', 'de acero', 'de fer'])}"])
    if slot == "tariff":
        return f"{_digits(r, 4)} {_digits(r, 2)} {_digits(r, 2)}"
    if slot == "amount":
        return r.choice([f"{r.randint(1, 999)},{_digits(r, 2)}", f"{r.randint(1, 29)}.{_digits(r, 3)},{_digits(r, 2)}", f"{r.randint(10, 9999)}.{_digits(r, 2)}", f"{r.randint(1, 999)},{_digits(r, 1)}", f"{r.randint(1, 99)},{_digits(r, 3)}.{_digits(r, 2)}"])
    if slot == "firm":
        f = family(r)
        t = _made(r, r.choice([1, 2])).capitalize() + r.choice(["bau", "technik", "handel", "werk", "bedarf", "service", "dienst", "waren", "möbel", "teile", "logistik", "druck"])
        sons = r.choice([" & Söhne", " & Sohn", " + Co", " u. Partner", " & Cie"]) if r.random() < 0.3 else ""
        town = f" {_plain(r, 'town')}" if r.random() < 0.25 else ""
        form = r.choice(["GmbH", "KG", "OHG", "e.K.", "GmbH & Co. KG", "SE", "AG", "UG", "mbH", "Ltd", "S.A.", "SARL", "S.L."])
        return r.choice([f"{f}{sons} {t}{town} {form}", f"{t} {f}{town} {form}", f"{t} {f}{sons} {form}", f"{f}{sons} {form}"])
    raise KeyError(slot)


_SLOTS = {"name": ("name", name), "family": ("name", family), "phone": ("phone", phone), "email": ("email", email), "idnum": ("idnum", idnum), "street": ("address", street)}
_CHOICE = re.compile(r"\[([^\[\]]*)\]")
#: Share of the words of running text that are replaced by made-up ones.
MADE_UP = 0.3


def _reworded(text: str, r: random.Random) -> str:
    def other(m: re.Match) -> str:
        if r.random() >= MADE_UP:
            return m[0]
        w = _made(r, r.choice([1, 1, 2]))
        return w.capitalize() if m[0][0].isupper() else w

    return re.sub(r"(?<![^\W\d_.])[^\W\d_]{5,}(?![^\W\d_.])", other, text)


def fill(row: str, r: random.Random) -> list[tuple[str, str]]:
    """A row as pieces (text, kind or "")."""
    row = _CHOICE.sub(lambda m: r.choice(m[1].replace(r"\|", "\0").split("|")), row.replace("\\|", "\0")).replace("\0", "|").replace("\\", "")
    running = len(row) > 45
    out, rest = [], row
    while "{" in rest:
        before, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        out.append((_reworded(before, r) if running else before, ""))
        if slot in _SLOTS:
            kind, make = _SLOTS[slot]
            out.append((make(r), kind))
        else:
            out.append((_plain(r, slot), ""))
    out.append((_reworded(rest, r) if running else rest, ""))
    return [p for p in out if p[0]]


_BODY = [x for x in ROWS if re.search(r"[.;]\]?$|\.\|", x) and "{family}[,|" not in x]
_LINES = [x for x in ROWS if x not in _BODY and "{family}" not in x and not x.startswith(("[Hallo|Lieber", "[Dear|Hi"))]
_GREET = [x for x in ROWS if x not in _BODY and x not in _LINES]
_FORMAL = [x for x in NEGATIVE if x.endswith((",", ":", "[,|:|]")) and "{" not in x]
_CLOSE = [x for x in NEGATIVE if "{" not in x and any(w in x for w in ("Grüße", "regards", "faithfully", "Cordialement"))]
_TEAMS = ["{W}"] + [x for x in NEGATIVE if "{" not in x and x not in _FORMAL and x not in _CLOSE]
_SUBJECT = ["{W} {W} {ref}   {w} {date}", "{W} {w}: {ref}   {W}: {date}"] + [x for x in NEGATIVE if x.startswith(("[Beleg", "[Invoice|Note", "[Facture|Avoir", "[Factura|Alb", "[AW"))]
_FIRM = [x for x in NEGATIVE if x == "{firm}"]
_ITEMS = [x for x in NEGATIVE if x.startswith(("  {", "Pos."))]
_STAMPS = [x for x in NEGATIVE if x.startswith(("[Eingang", "[Blatt"))]
_FACTS = [x for x in NEGATIVE if x.startswith(("[Waren", "[UID", "[Konto", "[Art.", "[Plan|Z", "[Format", "{n2} [", "[Postfach"))]
_TEXT = [x for x in NEGATIVE if "{" in x and x not in {*_SUBJECT, *_FIRM, *_ITEMS, *_STAMPS, *_FACTS, "{n5} {town}", "{W} {W} {ref}"}]


def letters(n: int, seed: int = 7) -> list[list[tuple[str, str]]]:
    """n labelled letters: a head, a block of address, running text, items and a foot, each there or not."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        doc: list[tuple[str, str]] = []

        def add(row: str, end: str) -> None:
            doc.extend(fill(row, r))
            doc.append((end, ""))

        if r.random() < 0.1:
            add(r.choice(_STAMPS), "\n")
        if r.random() < 0.7:
            add(r.choice(_FIRM), "\n")
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            add(r.choice(_FACTS), "\n")
        if r.random() < 0.5:
            doc.append(("\n", ""))
            if r.random() < 0.15:
                add("{firm}", "\n")
            add(r.choice(["{name}", "{name}", "{name}", "{name}", "[Herrn|Frau|Mr|Mme] {name}", *[x for x in ROWS if x.startswith("[z. Hd.")]]), "\n")
            add("{street}", "\n")
            add("{n5} {town}", "\n\n")
        if r.random() < 0.7:
            add(r.choice(_SUBJECT), "\n\n")
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            add(r.choice(_LINES), "\n")
        if r.random() < 0.6:
            add(r.choice(_GREET if r.random() < 0.5 else _FORMAL), "\n")
        for _ in range(r.randint(1, 7)):
            add(r.choice(_BODY if r.random() < 0.5 else _TEXT), r.choice([" ", " ", " ", "\n", "\n\n"]))
        for _ in range(r.choice([0, 0, 0, 1, 3])):
            add(r.choice(_ITEMS), "\n")
        for _ in range(r.choice([0, 0, 1])):
            add(r.choice([*_FACTS, *_STAMPS]), "\n")
        if r.random() < 0.6:
            doc.append(("\n", ""))
            add(r.choice(_CLOSE), "\n")
            if r.random() < 0.6:
                add("{name}", "\n")
            if r.random() < 0.8:
                add(r.choice(_TEAMS) + r.choice(["", "", r" \| {phone}", r" \| {email}", r" \| {phone} \| {email}", ", {phone}", " - {email}"]), "\n")
            if r.random() < 0.3:
                add(r.choice(_LINES), "\n")
        out.append(doc)
    return out
