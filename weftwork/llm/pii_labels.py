"""The labelled table from which the model of personal information is trained: lines with slots, and what fills them.

``{P}`` person, ``{E}`` email, ``{T}`` phone, ``{N}`` identity number and ``{A}`` street address are the labelled slots; ``{pl}`` place, ``{bld}`` building, ``{fam}``
family name alone, ``{st}`` street alone, ``{y}`` year, ``{n}`` ``{m}`` numbers, ``{big}`` grouped number, ``{ref}`` a number that is no identity,
``{date}`` and ``{user}`` are not. All content is invented, numbers and hosts are of reserved ranges, and no line stands in a test table.
Words of the lines, given names and street types are features of the model themselves; family names, places and hosts are known by
their shape only, as those of a corpus are others.
"""

from __future__ import annotations

import random
import re
import unicodedata

GIVEN = {
    "en": "James Mary Robert Patricia John Linda Michael Barbara William Susan David Jessica Richard Sarah Joseph Karen Thomas Lisa Charles Nancy Daniel Betty Matthew Helen Anthony Sandra Donald Ashley Mark Dorothy Paul Kimberly Steven Emily Andrew Donna Kenneth Michelle George Carol Joshua Amanda Kevin Melissa Brian Deborah Edward Stephanie Ronald Rebecca Timothy Laura Jason Sharon Jeffrey Cynthia Frank Kathleen Gary Amy Nicholas Shirley Eric Anna Stephen Angela Jonathan Ruth Larry Brenda Walter Virginia Harold Martha Arthur Alice Henry Frances Albert Jean Ralph Evelyn Roy Rose Eugene Judith Louis Grace Philip Doris Norman Edith Leonard Clara Stanley Hilda Ernest Mabel Howard Nora Trevor Joyce Graham Ivy Edwin Florence Owen Gladys Percy Sylvia Clifford Vera Nigel Maud".split(),
    "de": "Hans Anna Peter Ursula Klaus Karin Wolfgang Helga Jürgen Renate Dieter Elke Manfred Ingrid Uwe Monika Günter Gisela Horst Brigitte Bernd Christa Werner Gabriele Heinz Petra Gerhard Sabine Rainer Heike Karl Angelika Helmut Hannelore Otto Gerda Friedrich Ilse Heinrich Käthe Walter Bärbel Rüdiger Liesel Wolfram Hedwig Götz Margarete Dietmar Irmgard Siegfried Jutta Lothar Elfriede Volker Traute".split(),
    "fr": "Jean Marie Pierre Jeanne Michel Françoise André Monique Philippe Catherine René Nathalie Louis Isabelle Alain Jacqueline Jacques Anne Bernard Sylvie Marcel Martine Daniel Madeleine Roger Nicole Robert Suzanne Paul Hélène Claude Christine Christian Denise Henri Paulette Georges Simone Nicolas Odile François Mireille Lucien Solange Thibault Aurélie Étienne Clémence Gérard Jean-Luc Marie-Claire Yves Noëlle Marie-Noëlle Jean-Pierre Anne-Laure".split(),
    "es": "Antonio María José Carmen Manuel Josefa Francisco Isabel Juan Dolores David Pilar Javier Teresa Daniel Ana Carlos Cristina Jesús Laura Alejandro Francisca Miguel Antonia Rafael Mercedes Pedro Lucía Ángel Rosario Pablo Elena Sergio Concepción Fernando Rosa Jorge Manuela Luis Raquel Alberto Rocío Ramón Begoña Joaquín Nuria Andrés Inés Gonzalo Consuelo Fermín Maite Íñigo Marisol Eusebio Encarnación".split(),
}
FAMILY = {
    "en": "Smith Holloway Kimberley Maxwell Denison Thornby Haverhurst Coleman Whitby Larson Bexley Norwood Ashworth Caldwell Stanhope Brindley Oakley Hutchinson Farnham Ellery Prescott Wainwright Lockhart Tinsley Merriman Cromwell Harlow Penhurst Selby Robson Danvers Tilbury Eastman Mowbray Granger Ottley Wickham Sherwood Barlow Jessop".split(),
    "de": "Müller Neumann Steinbach Huber Albrecht Wieland Hofmann Dörfler Eisenring Brandhuber Kaufmann Lauterbach Vogel Ruprecht Zimmerling Wegener Sonnemann Kirchner Tauber Hollerbach Lindemann Oberhuber Gumprecht Messing Eberling Rossbach Kesting Baumann Fichtner Thalbach".split(),
    "fr": "Moreau Lenoux Giraud Mercier Pelletot Arnoux Renard Boisier Dubreau Charriot Vernier Gaillard Perrineau Tissot Marchais Bonnier Lagarde Poirot Delambre Sartoux Fournier Couteau Blanchard Robineau Mallet Chabot Rivier Dumoux".split(),
    "es": "García Nadal Cifuentes Ibáñez Barrueta Espinosa Olivando Quintanal Fernández Hermosa Zabaleta Marcial Arrando Gálvez Villegas Urrueta Penosa Carvajal Montiel Ordóñez Escobal Fernando Recueta Sandoval Almansa Rebolledo Iturria Peral".split(),
}
PLACES = "Harrowmere Coldfell Brindale Elmsworth Tarnwick Osterfeld Lindenau Wallbruck Neuhagen Birkental Montclair Vauvert Clairac Roquebelle Saintonge Valdoro Peñalba Riosol Montegrís Tarazal Fairhaven Millstead Greywater Northam Oakridge Steinau Rivolet Castaño Larkspur Dunmoor Gilby Orme Tessin Valle Brisa Korne Hude Ludo Marne Pavia Sorel Tiva Yarrow Zelle Quill Rhone Ister Umbra Nesso".split()
STREET_NAMES = "Maple Harbor Juniper Chapel Orchard Foxglove Elder Kingsway Station Mill Cedar Prospect Tanner Willow Quarry Bramble Linden Garten Rosen Kirch Mühlen Lavande Tilleuls Rosier Olivos Almendro Azahar Fuente".split()
HOSTS = "northwind stonebridge bluefern oldmill kastanie lindenhof bellevue montrose azulejo rivera openhill papermoon".split()
ENDS = "example invalid test".split()
BUILDINGS = "Weir Hall Mill Bridge Tower Chapel Station Dock Lodge Barn Railway Falls Bay Museum Company Court".split()
ROLES = "poet,painter,carpenter,organist,rower,surveyor,teacher,midwife,sculptor,pilot,goalkeeper,mayor,printer".split(",")

#: Lines by language.
TABLE = {
    "en": r"""
* {P}, {role}
* {P}, mayor from {y}
* {P} ({y}–{y}), {role} and author
* Treasurer: {P}, {A}, {pl}, {T}
* Chair: {P}
# {P} || {y} || {big}
| {y} || {P} || {n}
| {P} || {T} || {E}
| {P} || {A} || {T}
| author = {P}
| architect = {P}
| leader = {P} | population = {big}
| birth_name = {P}
| phone = {T}
| fax = {T}
| email = {E}
| contact = {E}
| address = {A}
| headquarters = {A}, {pl}
| website = {{URL|www.{host}.example}} | phone = {T}
| population_total = {big} | area_km2 = {n}.{m}
| isbn = 978-0-{n}-{m}-{n} | oclc = {ref}
| coordinates = {{coord|{n}|{m}|N|{n}|{m}|W}}
| established = {date}
{{Infobox officeholder | name = {P} | office = harbour master of [[{pl}]] | term_start = {y} }}
{{cite book |last={fam} |title=The old {pl} road |year={y} |page={n}}}
{{cite news |author={P} |title=A flood in {pl} |date={date}}}
{{Quote|Nobody here sleeps before the tide.|author={P}|year={y}}}
{{DEFAULTSORT:{Pr}}}
{{sort|{fam}|{P}}} || {big} || {n}
{{main|{pl} harbour}} See also [[{pl}]] and [[{pl} mill|the mill]].
<ref>{P}, personal communication, {date}.</ref>
<ref>{P}, letter to the parish, {A}, {pl}.</ref>
<ref>{P}: ''Stones of {pl}'', {y}, p. {n}.</ref>
<ref>{fam} ({y}), p. {n}.</ref>
<!-- to do: ask {P} at {E} -->
<!-- {P} lives at {A}, {pl} -->
<!-- source? see {A} in {pl} -->
<!-- please keep {ref} -->
'''{P}''' (born {date} in {pl}) is a {role} and teacher.
'''{P}''', a {role}, was born {date}, SSN {N}, and lives at {A}, Apt {n}, {pl}.
'''{pl} Mill''' is a restored mill in the district of [[{pl}]].
The station was planned by {P} and finished in {y}.
The station was planned by the engineer [[{P}]] and opened on {date}.
It was [[{P}|{fam}]] who bought the plan of {y}.
It was [[{P}]] who measured the wall.
In {y} the board, led by {P}, sold the pier for {big} crowns.
In {y} the board, led by [[{P}]] and {P}, sold the pier.
After the death of {P} in {y} the lamp went out.
After {P}'s death in {y} the inn was closed.
{P} was the first warden and {P} the last.
{Pr} was the first warden and {Pr} the last.
{P} left for {pl} in {y}. {fam} never came back.
{fam} left {pl} in {y}.
A note from {P} to {P} (dated {date}) says so.
A note from {Pr} to {Pr} (dated {date}) says so.
Work began under {P} but ended when the roof of [[{pl}]] fell in.
Writers such as {P} and {P} called it “lonely”. Others did not.
Writers such as {Pr} called it “lonely”.
According to {P}, the gate dates from {y}.
Thanks to {P} the bells ring again!
Please call {P} on {T} or write to {E}.
Please call {T} after six, ask for {P}.
call me {T} or mail {E} thx
call me at {T}!!!
everyone ring {T} and ask for {P}
text {T} or {T}
my number is {T} and my mail is {E} ok
my home: {A}, {pl}. come and see lol
my SSN is {N} haha
his SSN is {N} and his phone is {T}
her social security number {N} was printed by mistake
SSN: {N}
SSN {N}, NI number {N}
SSNs {N} and {N} belong to the children of {P}
SS# {N} ({P})
NI no. {N}; {P}, {A}
National Insurance number {N}
tax id {N}, passport {N}
Passport {N} of {P} was found in {pl}.
passport no. {N}
ID card {N} lost near {pl}, call {T}
''Found: grey cat. {T} ({P}), {A}, {pl}''
''Lost dog! {P}, {T}, {A}''
Contact: {E}, tel. {T}
Contact: {P}, {A}, {pl}, {E}
Contact {P} <{E}>
Tel. {T}, fax {T}
Tel: {T} | Fax: {T}
Phone {T} / mobile {T}
Write to {P}, {A}, {pl}.
Write to {E} or {E}.
[mailto:{E} write to the archive]
[mailto:{E} {P}]
{E};{E}
{E}, {E}
{E}
{T}
{P}
{Pr}
{A}
(talk) [[User:{user}|{user}]] – my cell: {T}
(talk) [[User:{user}]] {date}
--[[User:{user}|{user}]] {n}:{m}, {date} (UTC) I am {P}, see {E}
He moved to {A} in {y}, next to the bakery.
The office is at {A}, {pl}; open from {n} to {m}.
The parade runs along {st} and {st} every {y}.
{st}, its longest street, was paved in {y}.
The {st} line carries {big} t of coal a year, −{n} °C or not.
It lies {n} km north of [[{pl}]]. There are {n} steps; step {m} is loose.
Its plot no. {ref} is unlisted; ISSN {issn}.
Plots {ref} and {ref} are leased; ISBN {isbn}.
The {fam} Company ran {n} trains a day on line {m}.
The {fam} family sold it to the {pl} Society. Saint {pl} parish owns part of it.
Mount {pl}, {n}.{m} km away, is {big} m high. Room {n} is locked.
Admission @ {n} crowns each was thought dear. Source: {{{source}}}
Trains leave every {n} minutes; zone {m}. Score: {n}–{m} ({y}).
In {y}, {big} people lived here; {n}% of them were miners.
{| class="wikitable sortable"
|-
! Year !! Name !! Votes
|}
#REDIRECT [[{pl} Mill]]
[[File:{pl} bridge {y}.jpg|thumb|{n}px|The bridge, seen from the pier]]
[[Category:{pl}]] [[Category:Buildings of {y}]]
[[Category:People from {pl}|{Pr}]]
== Early years ==
The record {n}–{m} ({y}) stands.<!-- src? --> Nobody knows why…
Its soil is {n}% clay and {m}% sand. The river {pl} runs by.
Dear {user}, why did you delete page {ref}? rev {ref}, {date}
Version {n}.{m}.{n} of {date}; oldid={ref}; {{convert|{big}|ft|m}}
In the village hall hang portraits of {P}, {P} and {P}.
The choir was led by {P}; {P} played the organ.
Her brother {P} and her uncle {P} stayed in [[{pl}]].
They were received by mayor {P} and by Dr. {P}.
Signed: {P}, {pl}, {date}
'''{bld}''' is a disused ferry in the district of [[{pl}]].
'''{bld}''' is a lonely farm in [[{pl}]]. {st}, its oldest street, is short.
'''{bld}''' was a shop.
The log lists {big} ships. {st}, its oldest street, was paved in {y}.
The diary lists {big} ships and {big} sails; the barn holds {big} books.
Some {n} shops stand on {st}, most of them from {y}. The bus stops at {bld}.
Of {big} voters {big} came. {st} was closed.
{bld} and {bld} closed in {y}. {st} is quiet now.
| name = {bld}
{{Infobox building | name = {bld} | built = {y} | owner = {fam} }}
The weir of {bld} was sold to the {fam} family. It is {n} m long.
The dock of {bld} was given to [[{pl}]]. {P} signed.
{Pr} was its first cook and {P} the second.
[[File:{pl} dock {y}.jpg|thumb|{n}px|The dock, seen from the barn]] {P} was its first cook and {Pr} the second.
{{Contact | mail={E} | addr={A}, {pl}}} {{Box|tel={T}|addr={A}}}
born {date}, SSN {N}, resides {A}, {pl}, OH {n}{ref}
was born {date}, SS# {N}, lives at {A}, Apt {n}, {pl}
| {P} || {T} || {n} || {E}
| {P} || {T}
| {Pr} || {T} || {E}
| {T} || {P}
Sons of {P}: SSNs {N} and {N}
Both numbers, {N} and {N}, are in the file of {P}
the card says {N} or {N}
Daughter of {P}: {N} and {N}
Reward! {T} ({P}), {A}, {pl}
Found: one shoe. {T} ({P})
Its twin towns are {pl}, {pl} and [[{pl}]].
It is paired with {pl}, {pl} and [[{pl}]]. The {fam} family came from {pl}.
Neighbours: {pl}, {pl}, {pl} Falls and {pl}.
The chapel belongs to Saint {pl} parish. The vicar is {P}.
It belongs to Saint {pl} parish and the {pl} Trust.
The road from {pl} to {pl} Falls passes Lake {pl} and Fort {pl}.
A census of {y} gave it {big} inhabitants. {P} counted them.
It had {big} inhabitants in {y}, {big} in {y} and {big} later.
About {big} visitors, {n} dogs and {m} goats came. {big} Trees fell.
In {pl}, {P} painted a wall; the {pl} Museum keeps it.
Above the sea stands the old mill of {pl}. {P} ran it.
Part of the plan is by {P}. Part is lost.
Meanwhile, {P} sold bread there. Even so, {P} stayed.
born {date}, lives at {A}, {pl}, OH 00{ref}
resides {A}, Apt {n}, {pl}
Informant: {P}, of {A}, {pl}
Born in {y}, {P} first rowed for {pl}.
By all accounts, {P} kept the key. By {y}, it was gone.
(photo: {P}) [[{pl}]]
Cast: {P} as the miller; {P} as the ghost
Voters chose {P} over {P} by {n} to {m}.
""",
    "de": r"""
* {P}, Maler
* {P} ({y}–{y}), Tischler und Dichter
* Vorsitz: {P}
* Kassenwart: {P}, {A}, {pl}, {T}
| {y} || {P} || {big}
| {P} || {T} || {E}
| Telefon = {T}
| Leiter = {P}
| Anschrift = {A}
| E-Mail = {E}
| Einwohner = {big}
'''{P}''' (* {date} in {pl}) ist ein Ingenieur und Autor.
'''{pl}''' ist eine sanierte Siedlung bei [[{pl}]].
Gebaut wurde die Mühle von [[{P}]], danach kam {P}.
Der Plan stammt von {P} ({y}).
Der Plan stammt von {Pr} ({y}).
{P} führte den Laden bis {y}. {fam} zog nach {pl}.
{Pr} führte den Laden bis {y}.
Nach {P} heißt der Turm von {pl}.
Nach {Pr} heißt der Turm von {pl}.
Nach {P} und {P} sind Straßen benannt.
Laut {P} ist der Brunnen von {y}.
Auskunft gibt {P}, {A}, {pl}, {E}
Auskunft bei {P}, {A}, {pl}, Telefon {T}
Ruft an: {T}, {P} freut sich
Rufen Sie {P} unter {T} an.
ruf mich an {T} lg {P}
Fax {T}, mobil {T}
Telefon {T}, Fax {T}
Tel.: {T}
Steuer-ID {N} ({P})
Steuernummer {N}
Die IdNr. {N} gehört {P}.
Ausweis verloren! {P}, IdNr. {N}
Personalausweis {N}, {P}
Sozialversicherungsnummer {N} von {P}
Reisepass {N}
<!-- {P} wohnt {A}, {pl} -->
<!-- wohnt jetzt {A}, {pl} -->
<ref>{P}, Brief vom {date}.</ref>
<ref>{P}: ''Steine in {pl}'', {y}, S. {n}.</ref>
{{SORTIERUNG:{Pr}}}
{{DEFAULTSORT:{Pr}}}
Die Kanzlei sitzt in der {A} in {pl}.
Die {st} führt am Markt vorbei und heißt seit {y} so.
Die Straße „Am {pl}“ heißt seit {y} so.
Im Jahr {y} zählte der Ort {big} Einwohner. Rund {n} Häuser stehen dort.
Größe: {n},{m} Quadratkilometer; Höhe {big} m über NN.
Die Flurstücke {ref} sind verpachtet. Seit {y} fährt alle {n} Minuten ein Zug.
[[Datei:{pl} {y}.jpg|mini|Mühle in {pl}]] Die Anlage wurde {y} eröffnet und {y} stillgelegt.
#WEITERLEITUNG [[{pl} Mühle]]
Die Bundesstraße {n} führt an {pl} vorbei. Zudem gibt es {n} Stufen.
Der Kaufmann [[{P}]] erwarb {y} das Gut; sein Schwager {P} half.
Am {date} besuchten {P} und {P} den Hof.
Der Ort zählt {big} Einwohner. Im Jahr {y} waren es {big} Menschen.
Partnerorte sind {pl}, {pl} und [[{pl}]].
{pl} liegt {n} km südlich von {pl}. Übrigens: {P} wohnte dort.
Büro: {A}, {pl}
Mitteilung von {P}, {E}
Nach {P} ist der Hafen von {pl} benannt. {fam} verließ den Ort {y}.
Nach {Pr} ist die Brücke von {pl} benannt. Nach {P} auch.
Vereinslokal: {A}, 00{ref} {pl}
| {P} || {T}
Hinweise an {P}, {E}, {T}
Sitz des Vereins: {A}, 00{ref} {pl}
Die verlassene Mühle gehört der Familie {fam}. Zudem half {P}.
Nachbarn: {pl}, {pl} und {pl} Falls. {big} Gäste kamen.
Erst {P} öffnete das Tor. Dann kam [[{P}]].
Der Entwurf ist von {P}. Die Glocke fehlt.
""",
    "fr": r"""
* {P}, peintre
* {P} ({y}–{y}), menuisier et poète
* Trésorier : {P}, {A}, {pl}, {T}
| {y} || {P} || {big}
| {P} || {T} || {E}
| téléphone = {T}
| maire = {P}
| adresse = {A}
| courriel = {E}
| population = {big}
'''{P}''' (né le {date} à {pl}) est un ingénieur et auteur.
'''{P}''' (née le {date} à {pl}) est une sculptrice.
'''{pl}''' est un moulin restauré près de [[{pl}]].
Le maçon [[{P}]] le refit en {y}, avec {P}.
Le maçon [[{P}]] le refit en {y}, avec {Pr}.
{P} fut le premier directeur. Vers {y}, le four reste vide.
{Pr} fut le premier directeur.
{fam} partit de {pl} en {y}.
Selon {P}, le puits date de {y}.
Selon {Pr}, le puits date de {y}.
D'après {P} et {P}, la porte est de {y}.
Téléphonez au {T} et parlez à {P} !
Téléphonez à {P} au {T}, ou écrivez à {E}.
appelle moi {T} bisous {P}
Tél. {T}, télécopie {T}
Siège : {A}, {pl}
Mon adresse : {A}, {pl}, {E}
numéro de sécurité sociale {N} ({P})
n° de sécurité sociale : {N}
NIR {N}
Passeport {N} de {P}
carte d'identité {N}, {P}
numéro fiscal {N}
<!-- {P} habite {A}, {pl} -->
<!-- habite maintenant {A}, {pl} -->
<ref>{P}, lettre du {date}.</ref>
{{DEFAULTSORT:{Pr}}}
{{CLEDETRI:{Pr}}}
La mairie se trouve {A}, à {pl}.
La {st} traverse {pl}. On y compte {n} maisons le long de la route.
La parcelle {ref} reste vide. Vers {y}, altitude : {big} m ; superficie : {n},{m} km².
Un train part toutes les {n} minutes vers {pl}. Il se trouve à {n} km au nord.
[[Fichier:{pl} {y}.jpg|vignette|Le pont de {pl}]] Le pont porte le nom de la rivière {pl}.
#REDIRECTION [[Moulin de {pl}]]
Le notaire {P} vendit le pré à {P} en {y}.
Les frères {P} et {P} rouvrirent le four.
La ville comptait {big} habitants en {y}, puis {big} en {y}.
<!-- {Pr} habite {A}, 00{ref} {pl} -->
| {P} || {T} || {E} || {n}
| {P} || {T}
écrire à {P}, {A}, {pl}
écrivez à {P}, {A}, 00{ref} {pl}
Le barrage fut agrandi par {P}, aidé par {Pr}.
Villes jumelles : {pl}, {pl} et [[{pl}]].
Le chemin de {pl} Bay à {pl} passe par Saint-{pl}. En outre, {P} y vécut.
Bureau : {A}, 00{ref} {pl}
Voisins : {pl}, {pl} et {pl}. {big} Arbres tombèrent.
Pourquoi ce nom ? {P} ne le dit pas. {P} en rit.
L'ingénieur [[{P}]] l'acheva en {y}.
L'ingénieur {P} l'acheva.
{P} en fut la première gardienne, dit-on.
""",
    "es": r"""
* {P}, pintor
* {P} ({y}–{y}), carpintero y poeta
* Tesorera: {P}, {A}, {pl}, {T}
| {y} || {P} || {big}
| {P} || {T} || {E}
| teléfono = {T}
| alcalde = {P}
| dirección = {A}
| correo = {E}
| población = {big}
'''{P}''' (nacido el {date} en {pl}) es un ingeniero y autor.
'''{pl}''' es un molino cerca de [[{pl}]].
En {y} lo vendió [[{P}]], primo de {P}.
En {y} lo vendió [[{P}]], primo de {Pr}.
{P} fue su primer director. Cada {n} minutos sale un tren a {pl}.
{Pr} fue su primer director.
{fam} se fue de {pl} en {y}.
Según {P}, el pozo es de {y}.
Según {Pr}, el pozo es de {y}.
Según {P} y {P}, nadie lo vio.
Llame al {T} y pregunte por {P}.
Llame a {P}, {T}, o escriba a {E}.
llámame {T} saludos {P}
Tel. {T}, fax {T}
Sede: {A}, {pl}
DNI {N}, {P}
DNI: {N}
NIF {N} de {P}
Documento de identidad {N}, {P}
Pasaporte {N}
número de la seguridad social {N}
<!-- {P} vive en {A}, {pl} -->
<!-- ahora vive en {A}, {pl} -->
<ref>{P}, carta del {date}.</ref>
{{ORDENAR:{Pr}}}
{{DEFAULTSORT:{Pr}}}
La oficina está en {A}, en {pl}.
La {st} cruza {pl}. Hay {n} casas en el camino.
Además, el huerto debe su nombre al río {pl}. ¿Por qué se llama así?
Está a {n} km al norte de [[{pl}]]. La finca {ref} está vacía; ISBN {isbn}.
[[Archivo:{pl} {y}.jpg|miniatura|El puente de {pl}]] {pl} tiene {big} habitantes.
#REDIRECCIÓN [[Molino de {pl}]]
La maestra {P} y su hermano {P} abrieron el museo.
El notario {P} lo anotó el {date}.
La villa contaba {big} habitantes en {y}, y {big} en {y}.
| {P} || {T}
escriba a {P}, {A}, {pl}
Ciudades hermanas: {pl}, {pl} y [[{pl}]].
Hay {n} casas en el camino de {pl} Falls. {P} vive allí.
El huerto estrecho debe su nombre al río {pl}. {P} lo plantó.
Nadie lo sabe. {P} fue el primero. {P} fue la última.
Oficina: {A}, 00{ref} {pl}
Vecinos: {pl}, {pl} y {pl}. {big} Árboles cayeron.
Según {P}, el faro es de {y}. Además, [[{P}]] lo pintó.
Domicilio: {A}, {pl}
""",
}
_MONTHS = {"en": "January March May June August October".split(), "de": "Januar März Mai Juni August Oktober".split(), "fr": "janvier mars mai juin août octobre".split(), "es": "enero marzo mayo junio agosto octubre".split()}


def _plain(word: str) -> str:
    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFD", word.lower()))


def person(rng: random.Random, lang: str, reverse: bool | None = None) -> str:
    given, family = rng.choice(GIVEN[lang]), rng.choice(FAMILY[lang])
    if reverse if reverse is not None else rng.random() < 0.08:
        return f"{family}, {given}"
    middle = f" {rng.choice('ABCDEFGHKLMNPRST')}." if rng.random() < 0.2 else ""
    if rng.random() < 0.2:
        return f"{given[0]}.{middle if rng.random() < 0.3 else ''} {family}"
    if rng.random() < 0.08:
        family = family.upper()
    return f"{given}{middle} {family}"


def email(rng: random.Random, lang: str) -> str:
    g, f, h = _plain(rng.choice(GIVEN[lang])), _plain(rng.choice(FAMILY[lang])), rng.choice(HOSTS)
    user = rng.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}{rng.randrange(10, 99)}", f"info-{f}", f"{f}+news", f"{f}+wiki", g, f"{f}-{g}"])
    host = rng.choice([h, h, f"post.{h}", f"{h}-archive", f"mail.{h}"])
    at, dot = rng.choice([("@", ".")] * 6 + [(" @ ", "."), ("(at)", "(dot)"), (" [at] ", "."), (" [at] ", " [dot] "), (" AT ", " DOT "), ("&#64;", "."), ("＠", "."), (" at ", " dot ")])
    out = user + at + host.replace(".", dot) + dot + rng.choice(ENDS)
    return out.upper() if rng.random() < 0.06 else out


def phone(rng: random.Random, lang: str) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    if lang == "en":
        a, x = rng.choice("303 207 614 515 212 415".split()), "01" + d(2)
        return rng.choice([f"({a}) 555-{x}", f"{a}-555-{x}", f"{a}.555.{x}", f"{a} 555 {x}", f"+1 {a} 555 {x}", f"+1{a}555{x}", f"001-{a}-555-{x}", f"+1-{a}-555-{x}", f"+44 1632 960{d(3)}", f"01632 960{d(3)}", f"(01632) 960{d(3)}", f"+44 (0)1632 960{d(3)}"])
    if lang == "de":
        x = d(3)
        return rng.choice([f"(030) 23125 {x}", f"030/23125-{x}", f"+49 30 23125{x}", f"0049 30 23125{x}", f"+49 (0)30 23125-{x}", f"030 23125{x}", f"+493023125{x}", f"(030) 23125-{x}"])
    if lang == "fr":
        a, b = d(2), d(2)
        return rng.choice([f"01 99 00 {a} {b}", f"01.99.00.{a}.{b}", f"019900{a}{b}", f"019900{a}{b}", f"+33 1 99 00 {a} {b}", f"+33 (0)1 99 00 {a} {b}", f"0033 1 99 00 {a} {b}", f"+33199 00{a}{b}", f"01-99-00-{a}-{b}"])
    a, b = d(3), d(3)
    return rng.choice([f"555 {a} {b}", f"(+34) 555-{a}-{b}", f"+34 555 {a} {b}", f"+34555{a}{b}", f"0034 555{a}{b}", f"555-{a}-{b}", f"555{a}{b}"])


def identity(rng: random.Random, lang: str) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    letter = rng.choice("ABCDEFGHJKLMNPRSTVWXYZ")
    passport = f"ZZ{d(7)}"
    if lang == "en":
        area, group, rest = rng.choice(["000", "666", "9" + d(2)]), f"{rng.randrange(1, 99):02d}", d(4)
        a, b, c = d(2), d(2), d(2)
        end = rng.choice("ABCD")
        return rng.choice([f"{area}-{group}-{rest}"] * 2 + [f"{area} {group} {rest}"] * 2 + [f"QQ {a} {b} {c} {end}"] * 2 + [f"QQ{a}{b}{c}{end}"] * 2 + [passport])
    if lang == "de":
        a, b, c = d(3), d(3), d(3)
        return rng.choice([f"00{a}{b}{c}", f"00 {a} {b} {c}", f"00{a}{b}{c}", passport])
    if lang == "fr":
        s, yy, mm, dep, com, order, key = "9", d(2), f"{rng.randrange(13, 20)}", "99", d(3), d(3), d(2)
        return rng.choice([s + yy + mm + dep + com + order + key] * 2 + [f"{s} {yy} {mm} {dep} {com} {order} {key}"] * 2 + [passport])
    return rng.choice([f"{d(8)}{letter}"] * 2 + [f"{d(8)}-{letter}"] * 2 + [f"{d(8)} {letter}", passport])


def street(rng: random.Random, lang: str) -> str:
    name = rng.choice(STREET_NAMES)
    if lang == "en":
        return f"{name} {rng.choice('Street St Road Rd Avenue Ave Lane Ln Close Drive Dr Blvd Boulevard Court'.split())}"
    if lang == "de":
        return rng.choice([f"{name}straße", f"{name}str.", f"Am {name}weg", f"{name}weg", f"{name}gasse", f"Am {name}platz"])
    if lang == "fr":
        return f"{rng.choice(['rue', 'avenue', 'bd', 'boulevard', 'place', 'chemin', 'impasse', 'rue de la', 'rue des'])} {name}"
    return f"{rng.choice(['Calle', 'C/', 'Avenida', 'Avda.', 'Plaza', 'Calle de la', 'Av.'])} {name}"


def street_address(rng: random.Random, lang: str) -> str:
    n, s = rng.randrange(1, 990), street(rng, lang)
    if lang == "en":
        return rng.choice([f"{n} {s}"] * 4 + [f"{n} N. {s}", f"{n} W. {s}", f"Flat {rng.randrange(1, 40)}, {n} {s}", f"{n}{rng.choice('ab')} {s}", f"Unit {rng.randrange(1, 40)}, {n} {s}"])
    if lang == "de":
        return f"{s} {n}{rng.choice(['', '', '', 'a', 'b'])}"
    if lang == "fr":
        return rng.choice([f"{n} {s}", f"{n}, {s}", f"{n} bis {s}", f"{n} ter, {s}"])
    return rng.choice([f"{s}, {n}"] * 3 + [f"{s} {n}"] * 3 + [f"{s} n.º {n}", f"{s}, n.º {n}", f"{s} nº {n}"])


def _fillers(rng: random.Random, lang: str) -> dict:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    y, month = str(rng.randrange(1790, 2024)), rng.choice(_MONTHS[lang])
    day = rng.randrange(1, 29)
    point = rng.choice({"en": ",", "de": ".", "fr": " ", "es": "."}[lang] + ",. ")
    return {
        "pl": lambda: rng.choice(["", "", "", "", "Bad ", "New "]) * (lang == "en") + rng.choice(PLACES) + rng.choice(["", "", "", "-sur-Orle", " Bay"]), "bld": lambda: f"{rng.choice(PLACES)} {rng.choice(BUILDINGS)}", "fam": lambda: rng.choice(FAMILY[lang]), "st": lambda: street(rng, lang), "host": lambda: rng.choice(HOSTS),
        "y": lambda: str(rng.randrange(1790, 2024)), "n": lambda: str(rng.randrange(1, 99)), "m": lambda: str(rng.randrange(1, 60)), "big": lambda: f"{rng.randrange(1, 99)}{point}{d(3)}", "role": lambda: rng.choice(ROLES),
        "ref": lambda: rng.choice([f"{rng.randrange(1, 80)}-{d(2)}-{d(5)}", d(7), d(9), d(6), f"{d(4)}/{d(2)}"]), "issn": lambda: f"{d(4)}-{d(4)}", "isbn": lambda: rng.choice([f"978-{rng.randrange(1, 9)}-{d(4)}-{d(4)}-{d(1)}", f"978{d(10)}"]),
        "date": lambda: {"en": f"{day} {month} {y}", "de": f"{day}. {month} {y}", "fr": f"{day} {month} {y}", "es": f"{day} de {month} de {y}"}[lang],
        "user": lambda: rng.choice(PLACES)[: rng.randrange(3, 8)] + rng.choice(["", "", d(2)]),
    }


_KIND = {"P": ("person", person), "E": ("email", email), "T": ("phone", phone), "N": ("national_id", identity), "A": ("street_address", street_address)}
_SLOT = re.compile(r"\{(Pr|[PETNA]|pl|bld|fam|st|host|y|n|m|big|role|ref|issn|isbn|date|user)\}")


def templates() -> list[tuple[str, str]]:
    """(language, line) of the table."""
    return [(lang, line) for lang, block in TABLE.items() for line in block.strip().split("\n")]


def fill(lang: str, line: str, rng: random.Random) -> str:
    """The line with its slots filled, labelled spans as ⟦kind|text⟧; now and then in capitals."""
    fillers = _fillers(rng, lang)

    def put(m: re.Match) -> str:
        slot = m[1]
        # numbers and names of one country also stand in texts of another
        other = rng.choice(list(GIVEN)) if rng.random() < (0.35 if slot in "TN" else 0.08) else lang
        if slot == "Pr":
            return f"⟦person|{person(rng, other, True)}⟧"
        if slot in _KIND:
            kind, make = _KIND[slot]
            return f"⟦{kind}|{make(rng, other)}⟧"
        return fillers[slot]()

    out = _SLOT.sub(put, line)
    if rng.random() < 0.03:
        out = re.sub(r"(⟦\w+\|)|([^⟦]+)", lambda m: m[1] or m[2].upper(), out)
    return out


def labelled(copies: int = 12, seed: int = 7, only: list[tuple[str, str]] | None = None) -> list[str]:
    """Labelled lines: every line of the table ``copies`` times, some with another line of its language behind it."""
    rng = random.Random(seed)
    table = only or templates()
    by_lang: dict[str, list[str]] = {}
    for lang, line in table:
        by_lang.setdefault(lang, []).append(line)
    out = []
    for _ in range(copies):
        for lang, line in table:
            text = fill(lang, line, rng)
            if rng.random() < 0.3:
                text += " " + fill(lang, rng.choice(by_lang[lang]), rng)
            out.append(text)
    return out


def telling_words() -> set[str]:
    """The words that are features themselves: those of the lines, given names, street types and ways to hide an address."""
    words = {w.lower() for _, line in templates() for w in re.findall(r"[^\W\d_]+", _SLOT.sub(" ", line))}
    words |= {w.lower() for names in GIVEN.values() for n in names for w in n.split("-")}
    words |= set("street st road rd avenue ave lane ln close drive dr blvd boulevard court straße str weg am rue bd place chemin impasse calle c avenida avda plaza av bis ter flat unit n w s e at dot info post mail archive wiki news qq zz".split())
    words |= {*ENDS, *ROLES, *(w.lower() for w in BUILDINGS), *(m.lower() for ms in _MONTHS.values() for m in ms)}
    return words
