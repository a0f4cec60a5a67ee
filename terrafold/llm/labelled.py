"""The labelled table that the model for personal information is trained on: sentences with marked mentions.

The sentences are about offices, schools, clinics, shops, trains, clubs and houses, in six languages, and were written for this table;
none is taken from a text that the model is run on. A third are only strings of common words around a mention,
so that the model leans on what a mention itself looks like. Braces mark a mention by kind; what fills it is drawn from the forms
below, all invented from public formats. The expansion is seeded, so the table is the same everywhere. Sentences without mentions, and
the unmarked forms in them, are what must be left alone.
"""

from __future__ import annotations

import random

KINDS = ("name", "email", "phone", "idno", "address")

#: {N} name, {S} surname after a title, {E} e-mail, {P} phone, {I} identity number, {A} address; {w} a few words, {c} a capitalised one, {z} a number of a thing in the form of a person's.
MARKED = [
    "{N} chairs the meeting today; apologies came from {N}.", "Our new colleague {N} starts on Monday.", "The prize went to {N} of the junior class.", "{T} {S} will see you now.", "An appointment for {T} {S} is free on Friday.", "Ask {T} {S} or {N} for the key.",
    "Dear {T} {S},\nyour parcel has come back.", "Dear {N},\nthe lesson moves to room {n}.", "Yours sincerely,\n{N}", "Yours faithfully,\n{N}\n{A}", "Kind greetings from {N}\n{P}", "Love, {N}\n{A}\n{P}\n", "Signed: {N}\n", "Author: {N}\n", "Teacher: {T} {N}\n", "Patient: {N}\n", "Driver {N}\n The bus left late.", "Tenant: {N}\nRent is due.", "Guest: {T} {S}\n",
    "{N} said the lift is broken.", "{N} told us that the till was short.", "The receipt is made out to {N}, {A}.", "The parcel for {N}, {A}, was refused.", "Goods for {T} {N}, {A}.", "Invoice address: {N}, {A}.", "She lives at {A} with two cats.", "The shop moved to {A} last spring.", "Meet me at {A} at {time}.", "A fire was seen near {A}; nobody was hurt.", "Between {A} and {A} the road is closed.", "Bring the cake to {A} and ring twice.",
    "Post it to {A}.", "Collected from {A}", "Address: {A}", "Residence: {A}\n", "Call me on {P} after six.", "Call {P}.", "Phone: {P}", "Tel. {P}", "Mobile {P}, landline {P}.", "Fax {P}", "Fax: {P}\n", "Her number is {P}.", "If the alarm goes, dial {P} and wait.", "Reach the desk under {P} or {P}.", "Text {P} to cancel.", "The hotline ({P}) is busy.", "{P} is the number of the caretaker.", "ring {P}",
    "Mail {E} for a copy.", "E-mail: {E}", "Mail: {E}\n", "Write to {E} and to {E}.", "Contact {N} <{E}>", "From: {N} <{E}>\nSubject: minutes", "Cc: {E}; {E}", "{E} has bounced again.", "The form goes to {E} by noon.", "Questions? {E} or {P}", "Sent by {E}.", "reply to {E}, not to me",
    "Passport number {I}, holder {N}.", "Passport no. {I} expires soon.", "ID card {I} was found in the hall.", "His social security number is {I}.", "Social security: {I}", "NI number {I} for payroll.", "Tax ID {I}", "Tax number {I} of {N}.", "Insurance no. {I}, {N}", "The identity number {I} belongs to {N}.", "Identity document {I} shown by {T} {S}.", "Please strike {I} from the old form.", "Member {N}, ID {I}, {P}, {E}.", "Applicant {N} ({I}) lives at {A}.", "{N} ({I}), {A}, {P}", "{N} ({P}) keeps the spare key.", "The keys are with {N}, {P}.", "{N}, {E}, has the list.",
    "SSN {I}", "SSN {I} {w}.", "SSN: {I}", "SSN {I}, {N}", "Passport {I} {w}.", "passport {I}, {w}", "Passport no. {I} {w}.", "ID no. {I}.", "ID no. {I} {w}.", "{N}, ID no. {I}.", "ID {I}, {N}, {w}.", "ID number {I} {w}.", "identity number {I} {w}.", "identity number {I}, {A}, {w}.", "national ID {I} {w}.", "insurance number {I} {w}.", "Insurance number {I}, name {N}.", "NI no. {I} {w}.", "tax no. {I} {w}.", "Tax no. {I}", "Taxpayer {I} {w}.", "{w} {N} ({I}) {w}.", "{w} {N} ({I}), {E}.", "{w} {N} ({I}), {P}.", "Pièce d'identité {I} {w}.", "Carte d'identité {I} {w}.", "Passeport {I} {w}.", "Numéro de sécurité sociale {I} {w}.", "Ausweis Nr. {I} {w}.", "Ausweisnummer {I} {w}.", "Personalausweis {I} {w}.", "Reisepass {I} {w}.", "Steuernummer {I} {w}.", "DNI {I} {w}.", "{N}, DNI {I}.", "Pasaporte {I} {w}.", "Documento {I} de {N}.",
    "{w} lives at {A} {w}.", "{w} parked at {A} {w}.", "{w} from {A} {w}.", "{w} near {A} {w}.", "{w} of {A} {w}.", "{w} between {A} and {A} {w}.", "{w} to {A} and {w}.", "{w} to {A} for {T} {S}.", "{N}, {A}, {w}.", "{N}, {A}.", "{w}: {N}, {A}.", "{w}, {A}.", "{w} in {A} {w}.", "{w} bei {A}.", "{w} au {A}.", "{w} en {A}.",
    "Tel {P}", "Tel {P}, {E}", "Tel {P} or {E} {w}.", "Tel. {P} / {E}", "Tel {P} / {E} {w}.", "{P} / {E}", "{P}, {E}, {w}.", "{w} {P}, {w} {P}.", "{w} {P} or {P} {w}.", "{w} has {P}, {w}.", "{w} rang {P}.", "{w} at {A}, {w}.", "{A} {w}, {w}.", "{w} {A} {w} {A} {w}.", "{w} {w} and called {P}.", "{w}: {P}.", "{w} ({P}).", "{w} unter {P}.", "{w} au {P}.", "{w} al {P}.", "{w} teléfono {P}.", "{w} asked {N} and {T} {S} why {w}.", "{w} by {N}\n {w}.", "{w} for {w}, said {N}.", "{w}, said {T} {S}.", "{w}, wrote {N}.", "According to {N}, {w}.", "According to {T} {S}, {w}.", "Laut {T} {S} {w}.", "Laut Herr {S} {w}.", "Selon {F} {S}, {w}.", "Según {H} {S}, {w}.", "{w} with {N} {w}.", "{w} to {N} for {w}.", "{N} and {N} {w}.", "{N} ({w}) {w}.",
    "Yesterday {N} painted the wall.", "Later {T} {S} closed the shop.", "In the evening {N} counted the chairs and phoned {P}.", "On Tuesday {N} and {N} cleaned the hall.", "Nobody but {N} saw the dog.", "When the rain began, {N} shut the windows.", "After lunch {T} {S} taught the small group.", "{N} lost a glove.", "{N} sings, {N} plays the flute.", "{T} {S} and {T} {S} share a desk.", "We thank {N} for the flowers.", "a note from {N}", "as {N} wrote, the price is {n}", "the letter by {T} {S} is on file", "said {N}.", "asked {T} {S}.", "with {N} as referee", "{w} {N} {w}.", "{w} {T} {S} {w}.", "{w} {P} {w}.", "{w} {E} {w}.", "{w} {A} {w}.", "{w}, {N}, {w}.", "{N} {w}.", "{T} {S} {w}.", "{w} {N}.", "{w} {A}.", "{w} {P}.", "{w} {N} {w} {P}.", "{w}: {N}, {A}, {w}.", "{w} ({N}) {w}", "{c} {w} {N} {w}.", "{w} {c} {N}, {w} {E}.", "{w} {N} {w} {c} {c}.", "{c}: {N}\n {w}.", "{c}: {A}\n", "{w}; {N}: {w}.", "{w}\n{N}\n{A}\n{P}\n {w}.",
    "Sehr geehrter Herr {S},\nIhr Paket ist da.", "Sehr geehrte Frau {S},\nwir danken.", "Frau {S} hat den Schlüssel.", "Herr {S} kommt später.", "Unsere Lehrerin {N} ist krank.", "Mieter: {N}, {A}.", "Der Laden ist jetzt in {A}.", "Rufen Sie {P} an.", "Telefon: {P}", "Tel.: {P}, Fax: {P}", "Post an {E}.", "Personalausweis {I}, {N}.", "Steuernummer {I}", "Reisepass {I} von {N} liegt vor.", "Mit freundlichen Grüßen\n{N}\n{A}", "Treffpunkt ist {A} um {time}.", "Gestern hat {N} die Tür gestrichen.",
    "Monsieur {S} est absent.", "Madame {S} garde la clé.", "Bonjour {F} {S},\nvotre colis est arrivé.", "Notre voisine {N} chante bien.", "Locataire : {N}, {A}.", "Le magasin est au {A}.", "Téléphone : {P}", "Appelez le {P} ce soir.", "Écrire à {E}.", "Carte d'identité {I}, {N}.", "Passeport {I} de {N}.", "Cordialement,\n{N}\n{A}", "Hier, {N} a peint le mur.", "Rendez-vous au {A} à {time}.", "Le courrier de {F} {S} est là.",
    "Estimado {H} {S},\nsu paquete ha llegado.", "Nuestra vecina {N} canta bien.", "Inquilino: {N}, {A}.", "La tienda está en {A}.", "Teléfono: {P}", "Llame al {P} esta tarde.", "Escriba a {E}.", "Documento de identidad {I}, {N}.", "DNI {I}", "NIF {I} de {N}.", "Un saludo,\n{N}\n{A}", "Ayer {N} pintó la pared.", "La carta de {H} {S} está aquí.", "Nos vemos en {A} a las {time}.",
    "La signora {S} ha la chiave.", "Il maestro {N} arriva domani.", "Chiami il {P}.", "Scrivere a {E}.", "Passaporto {I} di {N}.", "De heer {S} komt morgen.", "Mevrouw {S} heeft de sleutel.", "Bel {P}.", "Paspoort {I} van {N}.", "O senhor {S} chega amanhã.", "Ligue para {P}.",
]

PLAIN = [
    "The meeting starts at {time} in room {n}.", "Order {d4}-{d3} has {n} parts and weighs {n}.{d1} kg.", "Train {n} to {Place} leaves at {time} from platform {d1}.", "Version {d1}.{d1}.{d2} fixes the crash on start.", "Chapter {n}: Of Time and Tides", "Lot {d6}, serial {c}{d8}, made in week {n}.", "Serial no. AB{d6}C, batch {d3}.", "Model {d3}-{d2}-{d4} is out of stock.", "Part {n}{d1}-{n}-{d4} fits the left door.", "Reference {d4} {d4} {d4} was not found.", "Barcode {d8}Z did not scan.", "Case {d5}-{d2} is closed.", "INV-{d6}: paid", "PO-{d5}: open", "See ticket REQ-{d5} and page {n}.",
    "The thermometer showed {n}.{d1} degrees at {time}.", "Position {deg}, {deg}.", "Lat {deg}, lon {deg}, height {n} m.", "Score {n} to {n} after {d1} rounds.", "Pay {n} euros by the end of March.", "Between {time} and {time} the pool is closed.", "Checksum {d4}-{d4}-{d4} is right.", "Retry {d3} {d3} {d4} times.", "Cable {d3} {d4} {d3} is worn.", "Frequency {d3}.{d3} {d4} Hz was noisy.", "Server 10.{d3}.{d3}.{d2} is down, code {d3}.", "Log at {time}:{d2}, code {d3}.{d3}.{d4}.", "Copied to /home/{Given}/data@{n} on the old disk.", "Use @home or #garden as tags.", "Camera cam{n}@{n}fps, file run{n}@v{n}.{n}.zip.", "Price list {n}/{n}, item {d8}.", "map_{d8}_{d6} and img_{d6} are the same.",
    "{firm} sent the bill.", "{Surname} {firm} {w}.", "{w} {Surname} {firm} {w}.", "{w} to {Surname} {firm}.", "The {w} is called {c} {c}, {w}.", "{c}-{d5}: {w}\n{w}.", "{c} {n} {w} {w}, {w}.", "{Surname} {firm} delivers on Friday.", "The clerk of {Surname} {firm} was late.", "{Surname} & {Surname} {firm} paid at once.", "We rent a van from {firm}.", "The {Surname} bridge is closed.", "{Surname} Street is wide and quiet.", "Turn into {Street} and park behind the school.", "Mount {Surname} is white with snow.", "The {Given} is a small boat, the {Surname} a large one.", "Our printer '{Given}' is out of ink.", "The robot called {Given} {w}.", "Tower {Surname} and mast {Given} are lit.", "Hall {Given} holds {n} guests.", "{Place} has a new library.", "A day in {Place}", "Welcome to {Place}!", "# {Place}", "Visit {n} at {Place}", "# Minutes, {Place}", "{c} {n} at {Place}\n\n{w}.", "# {c}, {Place}\n\n{w}.", "{c} at {Place}", "{w} from the {Surname} works.", "{w} {n} m from {Street} {w}.", "{w} the {Surname} {w}.", "The {Place} club won again.", "North of {Place} the road bends.", "{c} {c} is a kind of tea.", "The {c} {c} opens at {time}.",
    "In May the rose blooms, and April is wet.", "Mark the page, then bill the client.", "Grace and hope are fine words.", "Will you come?", "Please close the door behind you.", "Nothing was stolen.", "Two boys played in the yard.", "Monday is a holiday, Tuesday is not.", "English, French and Spanish are taught.", "Bread, milk, {n} eggs.", "How to bake bread", "What we learned", "To do:\n- sweep\n- paint", "No. {n} came first, no. {n} second.", "The driver, the cook and the nurse had lunch.", "A witness saw the crash but gave no name.", "The owner could not be reached by phone or mail.", "Tenants must not keep dogs.", "The manager asked the team to wait.", "His address is not known.", "Her passport has expired.", "The number was wrong.", "Dr. no longer practises here.", "Ms, Mr and Dr are titles.",
    "Serial {z}.", "Serial number {z} {w}.", "The serial of the engine is {z}.", "Part {z} {w}.", "Part number {z} on the {w}.", "Spare part {z} came today.", "Barcode {z} {w}.", "Label {z} {w}.", "Tag {z} {w}.", "Tag no. {z} hangs on the {w}.", "Key tag {z}.", "Ticket {z} {w}.", "Ticket number {z}.", "Order {z} {w}.", "Order no. {z} covers {n} {w}.", "Invoice {z} went to {firm}.", "Checksum {z}.", "Checksum {z} {w}.", "Hash {z} {w}.", "Item {z} {w}.", "Lot {z}, shelf {n}.", "Licence key {z}.", "Article {z} is sold out.", "Product code {z}.", "Device {z} {w}.", "Printer {z} {w}.", "Machine {z} {w}.", "Sensor {z}, sensor {z}.", "Tyre {z} {w}.", "Motor {z} {w}.", "Battery {z} {w}.", "Pump {z} {w}.", "Asset {z} {w}.", "Stock no. {z}", "Catalogue number {z}.", "ISBN {z}", "Range {z} was printed.", "Retry {n} times at {z} Hz.", "Channel {z} MHz {w}.", "Code {z} {w}.", "Build {z} {w}.", "Robot {z} {w}.", "Teil {z} fehlt.", "Seriennummer {z}", "Pièce {z} manque.", "Numéro de série {z}", "Pieza {z} agotada.", "Número de serie {z}",
    "Exit {n} North is closed.", "Bus {n} Left lane only.", "Count {n} cars on the road and {n} in the lane.", "Gate {n} East, row {n}.", "Page {n} Right column.", "Turn left after {n} metres, then right at the court.", "Stay {n} m away from {Street}.", "The corner of {Street} and {Street} is dark.", "{n} {w} street {w}.", "Drive {n} km along the road.", "About {n} {w} way {w} {n} {w}.", "{n} guests, {n} chairs, {n} {w}.", "ISO {n}, {n} {u} {w}.", "{c} {n}, {c} {n}, {w}.", "{w} {n} {u} {w}.", "{w} {n} {u}.", "{n} {u} {w} {n} {u}.", "{w}, {n} {u} {w}, {w}.", "{w} {n} {u} {c}.", "USB {n} {w}, type {n} {w}.", "{c} {n} {u}", "about {n} {u} of {w}", "{w} grew to {n} thousand {u} {w}.", "{w} {n} hundred {u} and {w}.", "{w} um {n} Prozent {w}.", "{w} auf {n} Tausend {c}.", "{w} {n} mil {w}.", "{w} {n} mille {w}.", "{n} {c} {w}.", "{n} {c} {c} {w}.",
    "Ask for {w} before you {w}.", "Ask the {w}.", "We asked why the {w}.", "According to the {w}, {w}.", "Reported by the {w}.", "Signed by the {w} in {Place}.", "Thanks to the {w}.", "Laut {w} {w}.", "Selon {w}, {w}.", "Según {w}, {w}.", "The {c} {w} {w}.", "{c} {w} {w}, {c} {w}.",
    "{w}.", "{w} {n} {w}.", "{w} {c} {w}.", "{w} {c} {c} {w}.", "{c} {w}, {w}.", "{w} '{c}' {w}.", "{w} {d3} {w} {d4}.", "{c}-{n}: {w}", "# {c} {c}, {w}", "{w} at {c} {c} {w}.", "{w} of {c} {w} {n}.{d2} {w}.", "{w} {time} {w}.", "{c} {w} {n} {w} {n} {w}.", "{w} {Place} {w}.", "{w} {Street} {w}.",
    "Der Zug nach {Place} fährt um {time}.", "Die Rechnung {d6} ist bezahlt.", "Der große Saal fasst {n} Gäste.", "Am Montag bleibt das Amt zu.", "Die Firma {Surname} {firm} liefert am Freitag.", "Das Haus hat {n} Zimmer und einen Garten.", "Die Tür war offen.", "Wie man Brot backt", "Le train pour {Place} part à {time}.", "La facture {d6} est payée.", "La grande salle a {n} places.", "La porte était ouverte.", "La maison {Surname} {firm} livre vendredi.", "El tren a {Place} sale a las {time}.", "La factura {d6} está pagada.", "La sala grande tiene {n} sillas.", "La puerta estaba abierta.", "La empresa {Surname} {firm} entrega el viernes.", "Il treno parte alle {time}.", "De trein vertrekt om {time}.",
]

#: Common words that stand around mentions, and capitalised words that are no names of people.
WORDS = (
    "the a an and or but so if then when while after before since until because with without under over near beside behind from into through about of for by at in on to was were is are has had will would can could may must not never always often again still only also very quite "
    "day week year hour morning evening house door window garden road wall roof floor table chair book paper letter list plan price card box bag key lock light water wind rain snow stone tree river field bridge school shop office hall room desk "
    "went came saw took gave made found kept lost sent read wrote said asked told heard held left opened closed moved turned started stopped waited called paid bought sold built broke fixed cleaned counted checked noted measured watched "
    "old new small large long short early late quiet loud dry wet clear dark red green white first second third last other same next"
).split()
FOREIGN = ["der die das ein eine und oder mit ohne unter über nach vor bei von zu war ist hat wird nicht nur auch sehr Haus Tür Straße Wasser Stadt Woche heute gestern morgen kam ging sah neu alt groß klein".split(), "le la les un une et ou avec sans sous sur après avant chez de à est a été sera pas plus aussi très maison porte rue eau ville semaine hier demain vint vit neuf vieux grand petit".split(), "el la los un una y o con sin bajo sobre tras antes de a es ha fue será no más también muy casa puerta calle agua ciudad semana ayer mañana vino vio nuevo viejo grande pequeño".split()]
CAPITALS = "Monday Tuesday Friday Sunday March June October Winter Summer Note Report Update Request Result Section Table Page Room Hall Gate Team Group Board Bank Park Museum Library Market Station Airport Harbour Castle Abbey Theatre College Academy Institute Union Council Project Blue Green Silver Golden Royal Central Northern Southern Eastern Western Great Little Double Magic Express Atlas Orion Delta Sigma Apollo Phoenix Panda Tiger Eagle Falcon Comet Galaxy Horizon Summit Pioneer Voyager Discovery Standard Premium Classic Original English German Spanish European".split()

UNITS = "frames percent points degrees seconds minutes metres km pieces litres pages words votes cells steps files rows times px m s Prozent Meter Punkte Stunden Bilder Grad Tausend points images mètres heures pour metros horas puntos imágenes por".split()

TITLES = ["Mr", "Mrs", "Ms", "Dr", "Mr.", "Mrs.", "Ms.", "Dr.", "Captain", "Prof.", "Professor", "Sir", "Miss", "Judge", "Sergeant", "Colonel", "Doctor"]
FRENCH, SPANISH = ["M.", "Mme", "Dr", "Mlle", "Monsieur", "Madame", "Maître"], ["Sr.", "Sra.", "la Sra.", "el Sr.", "Dr.", "Dra.", "señor", "la señora", "don", "doña"]
#: Frequent given names by language, and surnames; both public.
GIVEN = [
    "James Mary John Linda Robert Patricia Michael Jennifer William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Sandra Paul Emily Steven Donna Andrew Michelle Kevin Carol Brian Amanda George Laura Edward Sharon Ronald Amy Timothy Helen Jason Anna Ryan Ruth Gary Alice Peter Grace Henry Rose Adam Judy Kyle Joan Ethan Olivia Liam Sophia Noah Ava Mason Mia Lucas Ella Oliver Chloe Harry Evie Jack Freya Charlie Poppy Owen Megan Rhys Sian Ewan Isla Callum Eilidh Declan Aoife Sean Ciara May Will April Hope Victor Felix Simon Hugo Oscar".split(),
    "Hans Ursula Klaus Monika Wolfgang Petra Jürgen Sabine Dieter Renate Manfred Helga Uwe Karin Bernd Brigitte Stefan Andrea Matthias Claudia Jörg Heike Florian Katrin Tobias Nadine Lukas Leonie Jonas Greta Maximilian Hannah Finn Emma Björn Käthe Günther Ilse Torsten Anke Sven Birgit Jens Silke Ralf Gudrun".split(),
    "Jean Marie Pierre Nathalie Michel Isabelle Philippe Sylvie Alain Catherine Nicolas Céline Christophe Valérie Julien Aurélie François Hélène Olivier Sandrine Guillaume Élodie Mathieu Camille Antoine Manon Théo Léa Hugo Chloé Étienne Zoé René Noémie Gérard Agnès Benoît Maëlys Cédric Amélie Jean-Luc Anne-Marie Marie-Claire Jean-Marc".split(),
    "José María Antonio Carmen Manuel Josefa Francisco Isabel Juan Dolores Javier Pilar Carlos Teresa Miguel Ana Rafael Lucía Fernando Elena Álvaro Rocío Sergio Marta Pablo Nuria Andrés Inés Rubén Sofía Joaquín Raquel Íñigo Begoña Diego Valentina Mateo Camila Iker Ximena".split(),
    "Giuseppe Giulia Marco Chiara Luca Francesca Paolo Elisa Matteo Sara Jan Anneke Pieter Saskia Willem Femke Joost Marieke João Beatriz Tiago Inês Lars Ingrid Erik Astrid Nils Freja Mikkel Signe Håkan Åsa Jukka Aino Piotr Agnieszka Tomasz Katarzyna Jakub Zuzanna Ivan Olga Dmitri Natalia Sergei Tatiana Milan Jelena Zoltán Ildikó".split(),
    "Mohammed Fatima Ahmed Aisha Ali Zainab Omar Layla Yusuf Maryam Hassan Noor Ibrahim Amina Karim Salma Wei Ling Jun Mei Hiroshi Yuki Kenji Sakura Takashi Haruka Min-Jun Ji-Woo Hyun-Woo Seo-Yeon Arjun Priya Rahul Ananya Vikram Lakshmi Sanjay Meera Ravi Deepa Nguyen Linh Kwame Abena Kofi Ama Chinedu Ngozi Tunde Folake Thabo Naledi Amara Zola".split(),
]
SURNAMES = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Hall Wood Harris Clark Jackson Turner Hill Moore Cooper Ward Morris King Watson Baker Harrison Morgan Allen Parker Bennett Cook Shaw Ellis Foster Gray Hughes Butler Russell Barnes Fisher Pearson Graham Reynolds Murphy Kelly O'Brien Walsh Ryan Byrne MacDonald McKenzie Campbell Stewart "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Krüger Hofmann Lehmann Köhler Maier Huber Steinmann Baumgartner Lindqvist Andersson Johansen Nielsen Bergström Haugen Korhonen "
    "Martin Bernard Dubois Thomas Robert Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Bertrand Roux Fournier Girard Bonnet Dupont Lambert Fontaine Rousseau Chevalier Garnier Lopez Martínez González Rodríguez Fernández Sánchez Pérez Gómez Ruiz Hernández Jiménez Moreno Muñoz Álvarez Romero Navarro Domínguez Vázquez Ramos Castro Ortega Iglesias "
    "Rossi Ferrari Bianchi Romano Colombo Ricci Marino Conti Moretti Silva Santos Ferreira Kowalski Nowak Wójcik Novák Horvat Petrović Ivanov Popov Jansen Bakker Visser Hendriks Vermeulen Nagy Szabó Khan Hussain Rahman Haddad Mansour Chen Wang Li Zhang Tanaka Suzuki Sato Kim Park Lee Nguyen Tran Patel Singh Sharma Kumar Okafor Mensah Adeyemi Diallo Ndlovu"
).split()
PARTICLES = ["van", "von", "de", "van der", "van den", "de la", "di", "du", "al", "el", "ter", "da", "dos", "del", "Mac", "zu"]
#: Words before the names of places, sites and works.
PLACES_A = "Green Long Spring Fair Rock Silver Clear Stone Hill Lake Wood Mill Sunny High Bright Cold Deep Hazel Maple Cherry Old New East West North South Upper Lower Red White Black Fern Heron Otter Badger Raven Holly Ash".split()
#: Words that end the names of places, sites and works.
PLACES_B = "Bay Harbour Hills Park Cross Springs Point Grove Heights Valley Common Green Junction Beach Falls Moor Ridge Creek Island Marsh Meadow Forest Farm Mill Quarry Pit Mine Dam Weir Lock Canal Reservoir Basin Pond Wharf Pier Dock Quay Port Yard Depot Station Works Plant Tower Mast Bridge Viaduct Tunnel Causeway Bank Spit Cape Cliff Rock Gap Pass Plain Flats Fen Heath Down Wold Orchard Vineyard Gardens Terrace Field Landfill Airfield Ranch Estate Hall Castle".split()
AMBIGUOUS = "April May June Rose Grace Hope Faith Mark Will Bill Jack Frank Victor Dawn Iris Lily Olive Penny Art Guy Drew Summer Chance Rob Pat Sue Ray Gene".split()
TOWN_A, TOWN_B = ["Port", "East", "West", "North", "South", "Lower", "Upper", "New", "Old", "Great", "Little", "Saint", "San", "Bad", "Ville", "Long", "Market"], ["ford", "ton", "by", "ham", "bury", "mouth", "ville", "burg", "low", "water", "stead", "wick", "field", "bridge", "ley", "row", "stadt", "hausen", ""]
COMPOUND_A, COMPOUND_B = "mill stone bell salt copper thistle lark king church water wood iron apple goose fox sheep barley honey cart silver nettle willow bird rain snow winter summer rope saddle candle glass lime coal".split(), "field race marsh down spur fold gate croft founder maker hill side brook well yard bank acre wood ridge mead leaf hurst stead combe shot garth".split()
STREETS = ["Elm", "Oak", "Main", "Park", "Maple", "Cedar", "Victoria", "Albert", "Queen", "London", "York", "Windsor", "School", "Chapel", "Bridge", "Garden", "Market", "Castle", "Green", "Manor", "St. John", "St. Peter", "Old Post", "South End", "Abbey", "New Forest", "Lower Hill", "Bishop", "Baker", "Carlton"]
SUFFIX = ["Street", "Road", "Lane", "Avenue", "Close", "Court", "Drive", "Crescent", "Terrace", "Way", "Boulevard", "Square", "Row", "Gardens", "St", "Rd", "Ln", "Ave", "Ct", "Dr", "Blvd", "St.", "Rd.", "Ave.", "Dr.", "Place"]
GERMAN, FRENCH_WAYS, SPANISH_WAYS = ["Haupt", "Bahnhof", "Schul", "Dorf", "Berg", "Kirch", "Wald", "Rosen", "Goethe", "Schiller", "Ring", "Markt", "Feld", "Wiesen"], ["de la République", "des Écoles", "du Château", "de l'Église", "Jean Jaurès", "Pasteur", "de Paris", "des Tilleuls", "du Port", "Saint-Michel", "de la Fontaine", "des Vignes"], ["Real", "San Juan", "de Alcalá", "del Sol", "de la Iglesia", "Nueva", "de Colón", "Cervantes", "de los Olivos", "Santa Ana", "del Puerto", "de la Constitución"]
TOWNS = ["Springfield", "Millbrook", "Greenwich", "Harrow", "Newport", "Kingston", "Lincoln", "Bristol", "Dover", "Salem", "Georgetown", "Clifton", "Berlin", "Hamburg", "Münster", "Köln", "Lyon", "Nantes", "Bordeaux", "Lille", "Madrid", "Sevilla", "Toledo", "Bilbao", "Upper Norwood", "West Ham", "Saint-Denis", "Bad Homburg"]
TRADES = "Trading Foods Motors Insurance Logistics Bakery Brothers Consulting Bank Survey Mapping Aerial Media Design Energy Transport Systems Engineering Security Travel Books Hire Rentals Labs Studios Services Partners Drones Imaging Roofing Plumbing".split()
LEGAL = ["Ltd", "Ltd.", "Co.", "Inc.", "GmbH", "AG", "S.A.", "plc", "LLP", "SARL", "S.L.", "& Co. KG", "& Sons", "& Partners", "Holdings", "Group", "B.V."]
DOMAINS = ["example.com", "example.org", "example.net", "mail.example", "school.example", "shop.test", "clinic.invalid", "post.example.co", "uni.example.edu", "stadt.example.de", "mairie.example.fr", "correo.example.es", "a-b.example", "office.team.test"]


class _Draw:
    def __init__(self, rng: random.Random):
        self.r = rng

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def coined(self) -> str:
        """A surname that no list has, from syllables."""
        r = self.r
        return "".join(r.choice("b br c d dr f g gr h k kl l m n p pr r s st t tr v w".split()) + r.choice("a e i o u au ei".split()) for _ in range(r.randint(1, 2))).capitalize() + r.choice("n r s t l ck nd rt lm ng tt ss x vic ski sen son man berg ley ton ini etti ard eau ez os a e o ia ie el in us ina ella mir wyn beth rick bert hild ko mi dra".split())

    def surname(self) -> str:
        one = lambda: self.r.choice(SURNAMES) if self.r.random() < 0.4 else (self.r.choice(COMPOUND_A) + self.r.choice(COMPOUND_B)).capitalize() if self.r.random() < 0.2 else self.coined()
        s, x = one(), self.r.random()
        if x < 0.1:
            s += "-" + one()
        elif x < 0.13:
            s = self.r.choice(["O'", "D'"]) + s
        elif x < 0.21:
            s = self.r.choice(PARTICLES) + " " + s
        elif x < 0.24:
            s += " " + one()
        return s

    def given(self) -> str:
        if self.r.random() < 0.05:
            return self.r.choice(AMBIGUOUS)
        g = self.r.choice(self.r.choice(GIVEN))
        return g + "-" + self.r.choice(self.r.choice(GIVEN)) if self.r.random() < 0.05 and "-" not in g else g

    def name(self) -> str:
        g, s, x = self.given() if self.r.random() < 0.65 else self.coined(), self.surname(), self.r.random()
        if x < 0.12:
            return f"{g} {self.r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {s}"
        if x < 0.3:
            return f"{self.r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {s}"
        if x < 0.33:
            return f"{self.r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {self.r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {s}"
        if x < 0.48:
            return f"{s}, {g}"
        return f"{g} {s}"

    def email(self) -> str:
        r, plain = self.r, str.maketrans("äöüßéèêëàâçíóúñáåøãł", "aousééééaaciounaaoal")
        fold = lambda v: "".join(c for c in v.lower().translate(plain).replace("é", "e") if c.isascii() and c.isalnum())
        g, s = fold(self.given()) or "info", fold(self.surname()) or "desk"
        user = r.choice([f"{g}.{s}", f"{g[0]}{s}", f"{s}{self.digits(2)}", f"{g}_{s}", f"{g}-{s}", f"{g}+{r.choice(['news', 'shop', 'work', 'a'])}", s, f"{g}{self.digits(2)}", r.choice(["info", "office", "contact", "hello", "sales"]), f"{s}.{g[0]}", f"{g}_{s}-{r.choice(['hr', 'it', 'x'])}"])
        d, x = r.choice(DOMAINS), r.random()
        if x < 0.08:
            return f"{user} @ {d}"
        if x < 0.17:
            return f"{user} (at) {d.replace('.', ' (dot) ')}"
        if x < 0.26:
            return f"{user} at {d.replace('.', ' dot ')}"
        if x < 0.33:
            return f"{user}{r.choice(['[at]', ' [at] ', '(at)'])}{d}"
        if x < 0.36:
            return f"{user}[at]{d.replace('.', '[dot]')}"
        if x < 0.4:
            return f"{user}@\u200b{d}"
        return f"{user}@{d}"

    def phone(self) -> str:
        """Numbers as written in North America, Britain, Australia, France, Germany, Spain, Italy and elsewhere."""
        d, r = self.digits, self.r
        p = r.choice([
            f"{d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1{d(10)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"1 ({d(3)}) {d(3)}-{d(4)}",
            f"0{d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(4)}-{d(3)}-{d(3)}", f"07{d(3)} {d(6)}", f"07{d(9)}", f"+44 7{d(3)} {d(3)} {d(3)}", f"+44 7{d(3)} {d(6)}", f"+44 (0){d(4)} {d(6)}", f"+44 {d(2)} {d(4)} {d(4)}", f"0{d(9)}", f"04{d(2)} {d(3)} {d(3)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"(0{d(1)}) {d(4)} {d(4)}",
            f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 (0){d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(2)}/{d(7)}", f"0{d(3)}-{d(6)}", f"(0{d(2)}) {d(5)} {d(3)}", f"(0{d(3)}) {d(6)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 (0){d(3)} {d(7)}", f"+49-{d(3)}-{d(7)}", f"0049 {d(2)} {d(8)}", f"01{d(2)} {d(7)}",
            f"9{d(2)} {d(6)}", f"9{d(2)} {d(3)} {d(3)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}", f"9{d(2)}-{d(3)}-{d(3)}", f"+34 9{d(2)} {d(3)} {d(3)}", f"+34 6{d(8)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+31 {d(1)} {d(8)}", f"+351 {d(3)} {d(3)} {d(3)}", f"+48 {d(3)} {d(3)} {d(3)}", f"+91 {d(5)} {d(5)}", f"+86 {d(3)} {d(4)} {d(4)}", " ".join("0" + d(9)), " ".join("0" + d(7)) + " " + d(3),
        ])
        if r.random() < 0.12:
            p += r.choice([" ext. ", " ext ", " x", " x ", " extension ", ", ext. "]) + d(r.choice([2, 3, 4]))
        return p

    def idno(self) -> str:
        """Social security and taxpayer numbers, national insurance numbers, passports, national identity cards."""
        d, r = self.digits, self.r
        c, k = r.choice("ABCDEFGHJKLMNPQRSTVWXYZ"), r.choice("ABCEGHJKLMNPRSTWXYZ") + r.choice("ABCEGHJKLMNPRSTWXYZQ")
        return r.choice([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(9)}", f"{k} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{k}{d(6)}{r.choice('ABCD')}", f"{k}-{d(2)}-{d(2)}-{d(2)}-{r.choice('ABCD')}", f"{c}{d(7)}", f"{c}{d(8)}", f"{k}{d(7)}", f"{d(2)}{k}{d(5)}", f"{c}{d(2)}{k[0]}{d(4)}{k[1]}{d(1)}",
            f"{d(8)}{c}", f"{d(8)}-{c}", f"{d(2)}.{d(3)}.{d(3)}{c}", f"{d(2)}.{d(3)}.{d(3)}-{c}", f"{r.choice('XYZ')}{d(7)}{c}", f"{r.choice('XYZ')}-{d(7)}-{c}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{d(3)}/{d(3)}/{d(5)}",
        ])

    def town(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return r.choice(TOWNS)
        t = (r.choice(COMPOUND_A).capitalize() if r.random() < 0.3 else self.coined()) + r.choice(TOWN_B)
        return f"{r.choice(TOWN_A)} {t}" if r.random() < 0.45 else t

    def way(self) -> str:
        """The name of a street without the word for street."""
        r, x = self.r, self.r.random()
        w = r.choice(STREETS) if x < 0.35 else (r.choice(COMPOUND_A) + r.choice(COMPOUND_B)).capitalize() if x < 0.65 else self.coined() if x < 0.85 else r.choice(COMPOUND_A).capitalize()
        y = r.random()
        return f"{r.choice(['North', 'South', 'Upper', 'Lower', 'Old', 'New', 'Great', 'East', 'West'])} {w}" if y < 0.12 else f"St. {r.choice(r.choice(GIVEN))}" if y < 0.17 else f"{w} {r.choice(COMPOUND_B).capitalize()}" if y < 0.23 else w

    def street(self) -> str:
        return f"{self.way()} {self.r.choice(SUFFIX)}"

    def address(self) -> str:
        d, r = self.digits, self.r
        num, x = str(r.randint(1, 260)) + (r.choice("ABCabc") if r.random() < 0.12 else ""), r.random()
        if x < 0.12:
            a = f"{r.choice(GERMAN) if r.random() < 0.5 else self.coined() + r.choice(['', 'er', 'n', 's'])}{r.choice(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'strasse'])} {num}"
            return a + (f", {d(5)} {self.town()}" if r.random() < 0.55 else "")
        if x < 0.24:
            a = f"{num}{r.choice(['', '', '', ' bis', ' ter'])}{r.choice([', ', ' '])}{r.choice(['rue', 'avenue', 'chemin', 'impasse', 'place', 'boulevard', 'quai', 'allée', 'route'])} {r.choice(FRENCH_WAYS) if r.random() < 0.5 else r.choice(['de la ', 'du ', 'des ', "de l'", 'de ', '']) + self.coined()}"
            return a + (f", {d(5)} {self.town()}" if r.random() < 0.55 else "")
        if x < 0.34:
            a = f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Camino', 'Paseo', 'C/', 'Avda.'])} {r.choice(SPANISH_WAYS) if r.random() < 0.5 else r.choice(['de la ', 'del ', 'de los ', 'de ', '']) + self.coined()}{r.choice([', ', ' ', ', n.º '])}{num}"
            if r.random() < 0.4:
                a += f", {r.randint(1, 9)}.º {r.choice('ABCD')}"
            return a + (f", {d(5)} {self.town()}" if r.random() < 0.5 else "")
        if x < 0.37:
            return f"{r.choice(['Via', 'Piazza', 'Corso'])} {r.choice(['Roma', 'Garibaldi', 'Dante', 'Verdi'])} {num}" if r.random() < 0.5 else f"{r.choice(['Kerk', 'Dorps', 'Molen', 'School'])}{r.choice(['straat', 'weg', 'laan'])} {num}"
        if x < 0.42:
            a = f"{r.choice(['PO Box', 'P.O. Box', 'PO box', 'Postfach', 'BP'])} {d(r.choice([3, 4, 5]))}"
        else:
            a = f"{num} {self.street()}"
            if r.random() < 0.18:
                a = f"{r.choice(['Unit', 'Flat', 'Apt', 'Suite', 'Apartment', 'Room'])} {r.randint(1, 40)}{r.choice(['', '', 'B'])}, {a}"
            if r.random() < 0.18:
                a += ", " + r.choice([f"Suite {d(3)}", f"Apt {d(3)}", f"Apt. {d(2)}", f"#{r.randint(1, 99)}", f"Floor {r.randint(1, 9)}", f"Unit {r.randint(1, 30)}", f"{r.randint(2, 9)}th floor"])
        if r.random() < 0.55:
            a += r.choice([", ", ", ", ", ", "\n"]) + self.town()
            k = r.choice("ABCDEGHLMNPRSTW") + r.choice("ABDELMNRSTWXZQV")
            a += r.choice(["", "", f", {k} {d(5)}", f" {k} {d(5)}", f" {k}{d(1)} {d(1)}{k}", f" {k}{d(2)} {d(1)}{k}", f", {k}{d(2)} {d(1)}{k}", f" {d(4)}"])
        return a

    def plain(self, key: str) -> str:
        r = self.r
        if key[0] == "d" and key[1:].isdigit():
            return self.digits(int(key[1:]))
        return {
            "n": lambda: str(r.choice([r.randint(1, 40), r.randint(1, 990)])), "w": self.words, "c": lambda: r.choice(CAPITALS) if r.random() < 0.6 else self.word().capitalize(), "u": lambda: r.choice(UNITS), "z": lambda: r.choice([self.idno, self.idno, self.phone])(),
            "time": lambda: f"{r.randint(5, 21):02d}:{r.randint(0, 59):02d}", "deg": lambda: f"{r.uniform(-170, 170):.6f}", "firm": lambda: f"{r.choice(TRADES)} {r.choice(LEGAL)}" if r.random() < 0.6 else r.choice([*TRADES, *LEGAL]), "Surname": lambda: r.choice(SURNAMES) if r.random() < 0.6 else self.coined(),
            "Given": lambda: r.choice(r.choice(GIVEN)), "Place": lambda: f"{r.choice(PLACES_A) if r.random() < 0.5 else self.coined()} {r.choice(PLACES_B)}", "Street": lambda: f"{self.way()} {r.choice(SUFFIX[:4])}", "T": lambda: r.choice(TITLES), "F": lambda: r.choice(FRENCH), "H": lambda: r.choice(SPANISH),
        }[key]()

    def word(self) -> str:
        """A word in small letters that no list has."""
        if self.r.random() < 0.06:
            return f"{self.r.choice(WORDS)}-{self.r.choice(WORDS)}"
        return self.coined().lower() + self.r.choice(["", "", "s", "ed", "ing", "ly", "er", "tion", "able", "ness", "al", "ment", "e", "en", "ung", "ar", "ado", "ique"])

    def words(self) -> str:
        r = self.r
        of = WORDS if r.random() < 0.7 else r.choice(FOREIGN)
        out = " ".join(r.choice(of) if r.random() < 0.6 else self.word() for _ in range(r.randint(1, 6)))
        return out[0].upper() + out[1:] if r.random() < 0.3 else out

    def sentence(self, template: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The expanded sentence and its mentions (kind, begin, end)."""
        makes = {"N": ("name", self.name), "S": ("name", lambda: self.surname() if self.r.random() < 0.75 else f"{self.given()} {self.surname()}"), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("idno", self.idno), "A": ("address", self.address)}
        out, mentions, at = "", [], 0
        while True:
            b = template.find("{", at)
            if b < 0:
                return out + template[at:], mentions
            e = template.index("}", b)
            out += template[at:b]
            key, at = template[b + 1 : e], e + 1
            if key in makes:
                kind, make = makes[key]
                v = make()
                x = self.r.random()
                if x < 0.06:
                    v = v.upper()
                elif x < 0.12 and kind != "email":
                    v = v.replace(" ", " ", 1)
                # An abbreviated street at the end of a sentence shares its dot with it.
                if v.endswith(".") and kind == "address" and template[at : at + 1] == ".":
                    v = v[:-1]
                mentions.append((kind, len(out), len(out) + len(v)))
                out += v
            else:
                out += self.plain(key)


def table(rows: int = 7000, seed: int = 11, marked: list[str] | None = None, plain: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of one to five sentences with their mentions; some wholly in upper or lower case, some numbered or timed. marked, plain: other sentences than this module's."""
    marked, plain = marked or MARKED, plain or PLAIN
    rng = random.Random(seed)
    d = _Draw(rng)
    out = []
    for _ in range(rows):
        text, mentions = "", []
        style = rng.random()
        for k in range(rng.randint(1, 5)):
            t, m = d.sentence(rng.choice(marked) if rng.random() < 0.6 else rng.choice(plain))
            x = rng.random()
            lead = f"{rng.randint(5, 21):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d} " if x < 0.12 else f"[{rng.randint(5, 21):02d}:{rng.randint(0, 59):02d}] {rng.choice(['desk', 'user', 'agent', 'bot'])}{rng.randint(1, 9)}: " if x < 0.24 else f"{rng.randint(1, 90)}. " if x < 0.36 else ""
            sep = "" if not k else rng.choice([" ", " ", " ", "\n", "\n\n", "  ", "\r\n"]) if not lead.startswith("[") and not (lead and lead[0].isdigit() and lead.endswith(". ")) else "\n"
            shift = len(text) + len(sep) + len(lead)
            text += sep + lead + t
            mentions += [(kind, b + shift, e + shift) for kind, b, e in m]
        if style < 0.07 and len(text.upper()) == len(text):
            text = text.upper()
        elif style < 0.2 and len(text.lower()) == len(text):
            text = text.lower()
        out.append((text, mentions))
    return out
