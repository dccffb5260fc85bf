"""Blocks of twenty pages, read and labelled by hand, for the tree that tells page bodies.

Each: number of the page, kind (L link, H heading, B button, - other, $ a price), share of the site's pages with the block's rarest line, the same with names
masked, label (1 body, 0 boilerplate, -1 residue that is no training row but a neighbour), text. Pages from ``HELD_OUT`` on are not trained on.
"""

HELD_OUT = 15
BLOCKS = [
    (0, 'L', 1.0, 1.0, 0, 'Connexion'),
    (0, 'L', 1.0, 1.0, 0, 'Tarifs'),
    (0, '-', 0.923, 0.923, 0, 'Accueil'),
    (0, 'L', 0.962, 0.962, 0, 'Guide'),
    (0, 'L', 1.0, 1.0, 0, 'À propos'),
    (0, '-', 0.885, 0.885, 0, 'Jipomodiru utilise des cookies pour la connexion.'),
    (0, '-', 0.885, 0.808, 0, 'Gérez les cookies déposés par Jipomodiru.'),
    (0, 'B', 0.885, 0.885, 0, 'Tout accepter'),
    (0, 'B', 0.885, 0.885, 0, 'Re\u200c\u200cfuser'),
    (0, 'H', 0.0, 0.808, 1, 'Tarifs de Hapekive'),
    (0, '-', 0.5, 0.0, 0, 'Par  la  rédaction  de  Jipomodiru'),
    (0, '-', 0.0, 0.0, 1, 'Hapekive - Après la mise à jour, la fiche détaillée précède la fiche détaillée cachée.'),
    (0, '-', 0.0, 0.0, 1, 'Hapekive - Dès 89 comptes, Hapekive affiche la clé de suivi manquante.'),
    (0, '-', 0.0, 0.0, 1, 'Hapekive: la clé de suivi reste vide tant que la requête cachée charge.'),
    (0, '-', 0.0, 0.0, 1, "En janvier, Hapekive a relevé 15 écarts dans la période d'essai. En février, Hapekive a relevé 45 écarts dans la liste des écarts. La période d'essai "),
    (0, '-', 0.5, 0.5, 0, 'Partagé 252 fois'),
    (0, 'H', 0.5, 0.5, 0, 'Les plus lus'),
    (0, '-', 0.5, 0.5, 0, 'À lire aussi'),
    (0, 'L', 0.0, 0.769, 0, 'Découvrir Bavidega'),
    (0, 'L', 0.0, 0.808, 0, 'Tarifs de Forajuni'),
    (0, 'L', 0.0, 0.808, 0, 'Tarifs de Dagoguni'),
    (0, 'L', 0.808, 0.808, 0, 'Confidentialité'),
    (0, 'L', 0.808, 0.769, 0, '© 2021 Jipomodiru. Tous droits réservés.'),
    (0, 'L', 0.808, 0.808, 0, 'MENTIONS LÉGALES'),
    (1, 'L', 1.0, 1.0, 0, 'Changelog'),
    (1, 'L', 0.919, 0.919, 0, 'Plans & billing'),
    (1, 'L', 1.0, 1.0, 0, 'Docs'),
    (1, 'L', 1.0, 1.0, 0, 'Blog'),
    (1, 'L', 1.0, 1.0, 0, 'Status'),
    (1, 'H', 0.0, 0.0, 1, 'Jutoguli release notes'),
    (1, 'B', 0.541, 0.541, 0, 'Copy link to this article'),
    (1, '-', 0.0, 0.0, 1, 'Jutoguli, Compare the release note with the second link graph before you upgrade.'),
    (1, '-', 0.0, 0.0, 1, 'If the baseline is short, the crawler skips the event log and reports it.'),
    (1, '-$', 0.0, 0.0, 1, 'The agency plan of Jutoguli costs $62 / month and includes 49 seats.'),
    (1, '-', 0.0, 0.0, 1, 'Open the refund window, choose the slow account menu and save the page. The menu of the delivery notice lists 17 links, most of them empty.'),
    (1, '-', 0.0, 0.0, 1, 'The privacy page of Jutoguli names the older sitemap entry and 50 partners.'),
    (1, '-', 0.541, 0.541, 0, 'Copy link to this article'),
    (1, '-', 0.541, 0.541, 0, '883 people shared this'),
    (1, 'B', 0.514, 0.514, 0, 'Share with your team'),
    (1, '-', 0.676, 0.676, 0, 'Plan names belong to their owners; Teremaderu is not liable for errors in third-party prices.'),
    (1, 'H', 0.27, 0.27, 0, 'Recommended for you'),
    (1, '-', 0.27, 0.27, 0, 'Get the weekly digest of Teremaderu'),
    (1, 'L', 0.0, 0.0, 0, 'Jotaminu overview'),
    (1, 'L', 0.0, 0.0, 0, 'Suzivetu limits'),
    (1, '-', 0.973, 0.973, 0, 'Privacy'),
    (1, 'L', 0.973, 0.973, 0, 'PRICES EXCLUDE LOCAL TAXES UNLESS STATED OTHERWISE.'),
    (1, '-', 0.973, 0.973, 0, 'Terms of use'),
    (1, 'L', 0.973, 0.892, 0, 'Made by the Teremaderu team in two time zones.'),
    (2, 'L', 1.0, 1.0, 0, 'Changelog'),
    (2, 'L', 0.919, 0.919, 0, 'Plans & billing'),
    (2, 'L', 1.0, 1.0, 0, 'Doc\xads'),
    (2, 'L', 1.0, 1.0, 0, 'Blog'),
    (2, 'L', 1.0, 1.0, 0, 'Status'),
    (2, '-', 0.486, 0.459, 0, 'We and 437 partners store small files on this device to run Teremaderu.'),
    (2, '-', 0.486, 0.486, 0, 'Teremaderu uses cookies to remember your settings. Read the cookie policy.'),
    (2, 'B', 0.486, 0.486, 0, 'Manage choices >'),
    (2, 'B', 0.486, 0.486, 0, 'Accept all'),
    (2, 'H', 0.0, 0.0, 1, 'Susufeni guide'),
    (2, '-', 0.0, 0.0, 1, 'Readers asked for a renamed refund window without notice, and Susufeni added one.'),
    (2, '-', 0.0, 0.0, 1, 'Our broken billing form changed, so the seat count has to be read again.'),
    (2, '-', 0.0, 0.0, 1, 'It takes 81 minutes until the quiet checkout button appears in the plan card.'),
    (2, 'B', 0.541, 0.541, 0, 'Copy link to this article'),
    (2, '-', 0.541, 0.541, 0, '794 people shared this'),
    (2, '-', 0.27, 0.27, 0, 'Recommended for you'),
    (2, 'H', 0.27, 0.27, 0, 'Get the weekly digest of Teremaderu'),
    (2, 'L', 0.0, 0.0, 0, 'Jutoguli release notes'),
    (2, 'L', 0.0, 0.0, 0, 'Jotaminu overview'),
    (2, 'L', 0.0, 0.0, 0, 'Suzivetu limits'),
    (2, 'L', 0.973, 0.973, 0, 'PRIVACY'),
    (2, 'L', 0.973, 0.973, 0, 'Prices exclude local taxes unless stated otherwise.'),
    (2, '-', 0.973, 0.973, 0, 'Terms of use'),
    (2, 'L', 0.973, 0.0, 0, 'Made  by  the  Teremaderu  team  in  two  time  zones.'),
    (3, 'L', 0.955, 0.955, 0, 'Status'),
    (3, 'L', 0.955, 0.955, 0, 'Plans & billing'),
    (3, 'L', 0.955, 0.955, 0, 'Docs'),
    (3, 'L', 0.955, 0.955, 0, 'Home'),
    (3, 'L', 0.955, 0.955, 0, 'Support'),
    (3, '-', 0.909, 0.909, 0, 'Momabodiru uses cookies to remember your settings. Read the cookie policy.'),
    (3, 'B', 0.909, 0.909, 0, 'Reject optional'),
    (3, 'B', 0.909, 0.909, 0, 'Manage choices'),
    (3, 'H', 0.0, 0.0, 1, 'Husosafi overview'),
    (3, '-', 0.0, 0.545, 0, 'Reviewed by the Momabodiru editors on 4 May'),
    (3, '-', 0.0, 0.0, 1, 'Between 61 and 51 captures of Husosafi the seat count moved.'),
    (3, '-$', 0.0, 0.0, 1, 'The campus plan of Husosafi costs $147 / month and includes 89 seats.'),
    (3, '-', 0.0, 0.0, 1, 'Between 95 and 58 captures of Husosafi the status badge became disabled. Support answered that the crawl queue opened in a new frame during the night crawl. Subscribers of Husosafi keep their renamed table of contents at the old price of $173.'),
    (3, '-', 0.0, 0.0, 1, 'Our annual retry budget opened in a new frame, so the redirect rule has to be read again.'),
    (3, '-', 0.0, 0.0, 1, 'Every redirect rule of Husosafi now shows the narrow refund window first. Nobody noticed that the sign-in form kept its place when the cache was cold. Placeholder copy is fine in a mock-up, but the discount code needs real words in every region.'),
    (3, 'H', 0.0, 0.0, 1, 'Husosafi plans'),
    (3, '-', 0.0, 0.0, 1, 'It takes 54 minutes until the second delivery notice appears in the link graph.'),
    (3, 'H', 0.0, 0.0, 1, 'Questions about Husosafi'),
    (3, '-', 0.0, 0.0, 1, 'Never publish the crawl queue without the slow link graph!'),
    (3, '-', 0.0, 0.0, 1, 'A 404 page of Husosafi should explain what happened to the nested price history. Compare the invoice view with the missing frame tree before you upgrade. The sign-in form and the seat count share one label since the last check.'),
    (3, '-$', 0.0, 0.0, 1, 'Husosafi agency: $135 / month'),
    (3, '-', 0.545, 0.0, 0, 'Nothing  here  is  advice.  Check  the  contract  of  Momabodiru  before  you  buy.'),
    (3, 'L', 0.909, 0.0, 0, 'MADE BY THE MOMABODIRU TEAM IN TWO TIME ZONES.'),
    (3, '-', 0.909, 0.909, 0, 'Privacy'),
    (3, '-', 0.909, 0.864, 0, '© 2019 Momabodiru. All rights reserved.'),
    (3, 'L', 0.909, 0.909, 0, 'Imprint'),
    (4, 'L', 0.88, 0.88, 0, 'Careers'),
    (4, 'L', 0.96, 0.96, 0, 'Plans & billing'),
    (4, 'L', 0.94, 0.94, 0, 'Changelog'),
    (4, 'L', 0.9, 0.9, 0, 'About us'),
    (4, 'H', 0.0, 0.0, 1, 'Kepegeme release notes'),
    (4, '-', 0.66, 0.66, 0, '144 min read'),
    (4, 'B', 0.48, 0.48, 0, 'Save for later'),
    (4, '-', 0.0, 0.0, 1, 'We moved the redirect rule below the retry budget without notice.'),
    (4, '-', 0.0, 0.0, -1, '[[ headline ]]'),
    (4, '-', 0.0, 0.0, 1, 'We moved the usage meter below the price label when the cache was cold.'),
    (4, '-', 0.0, 0.0, 1, 'Is the empty price label of Kepegeme still needed without notice?'),
    (4, '-', 0.48, 0.48, 0, 'Save for later'),
    (4, 'H', 0.54, 0.54, 0, '- Popular this week'),
    (4, 'H', 0.54, 0.48, 0, 'Get the weekly digest of Fimobaderu'),
    (4, 'L', 0.0, 0.0, 0, 'Totehovo overview'),
    (4, 'L', 0.0, 0.0, 0, 'Jusojevu overview'),
    (4, 'L', 0.0, 0.0, 0, 'Fafagolu for teams'),
    (4, '-', 0.82, 0.82, 0, 'Prices exclude local taxes unless stated otherwise.'),
    (4, 'L', 0.82, 0.82, 0, 'Imprint'),
    (4, '-', 0.82, 0.82, 0, 'Privacy'),
    (4, '-', 0.82, 0.72, 0, 'Fimobaderu is a trademark of Fimobaderu Holdings, registry no. 547.'),
    (4, '-', 0.82, 0.64, 0, 'Follow Fimobaderu for release news'),
    (5, 'L', 1.0, 1.0, 0, 'Precios'),
    (5, 'L', 0.97, 0.97, 0, 'GUÍA'),
    (5, '-', 1.0, 1.0, 0, 'Quiénes somos'),
    (5, 'L', 0.97, 0.97, 0, 'Ayuda'),
    (5, '-', 1.0, 1.0, 0, 'Entrar'),
    (5, 'L', 0.97, 0.97, 0, 'Inicio'),
    (5, '-', 0.0, 0.0, -1, 'JavaScript is required. natonuru cannot start without it.'),
    (5, 'H', 0.667, 0.667, 0, 'Lo más leído'),
    (5, 'H', 0.667, 0.667, 0, 'También le interesa'),
    (5, 'L', 0.0, 0.818, 0, 'Precios de Relimene'),
    (5, 'L', 0.0, 0.879, 0, 'Cómo funciona Pazomele'),
    (5, 'L', 0.0, 0.879, 0, 'Cómo funciona Fitavihi'),
    (5, '-', 0.909, 0.909, 0, 'Privacidad'),
    (5, '-', 0.909, 0.848, 0, '© 2025 Nosoraderu. Todos los derechos reservados.'),
    (5, '-', 0.909, 0.909, 0, 'Aviso legal'),
    (6, 'L', 1.0, 1.0, 0, 'Precios >'),
    (6, 'L', 0.97, 0.97, 0, 'Guía'),
    (6, 'L', 1.0, 1.0, 0, 'Quiénes somos'),
    (6, 'L', 0.97, 0.97, 0, 'Ayuda'),
    (6, 'L', 1.0, 1.0, 0, 'Entrar'),
    (6, 'L', 0.97, 0.97, 0, 'Inicio'),
    (6, '-', 0.667, 0.636, 0, 'Elija qué cookies puede guardar Nosoraderu.'),
    (6, '-', 0.667, 0.667, 0, 'Nosoraderu usa cookies para recordar la sesión.'),
    (6, 'B', 0.667, 0.667, 0, 'Aceptar todo'),
    (6, 'B', 0.667, 0.667, 0, 'Rechazar'),
    (6, 'H', 0.0, 0.818, 1, 'Precios de Nujofuve'),
    (6, '-', 0.424, 0.333, 0, 'Redacción de Nosoraderu'),
    (6, '-', 0.0, 0.0, 1, 'Nujofuve, En mayo, Nujofuve revisó la página guardada y halló 49 errores más.'),
    (6, '-', 0.0, 0.0, 1, 'Nujofuve - con 86 cuentas, Nujofuve enseña la sección oculta última.'),
    (6, 'B', 0.636, 0.636, 0, 'Compartido 72 veces'),
    (6, '-', 0.606, 0.606, 0, 'Los precios de Nosoraderu son orientativos.'),
    (6, '-', 0.667, 0.667, 0, 'Lo  más  leído'),
    (6, '-', 0.667, 0.667, 0, 'También le interesa'),
    (6, 'L', 0.0, 0.879, 0, 'Cómo funciona Huvejihi'),
    (6, 'L', 0.0, 0.879, 0, 'Cómo funciona Zudihiza'),
    (6, 'L', 0.909, 0.909, 0, 'Privacidad'),
    (6, 'L', 0.909, 0.848, 0, '© 2019 Nosoraderu. Todos los derechos reservados.'),
    (6, 'L', 0.909, 0.909, 0, 'Aviso legal'),
    (7, 'L', 0.913, 0.913, 0, 'Über uns'),
    (7, 'L', 0.903, 0.903, 0, 'Hilfe'),
    (7, 'L', 0.913, 0.913, 0, 'Start'),
    (7, 'L', 0.922, 0.922, 0, 'Anmelden'),
    (7, 'L', 0.922, 0.922, 0, 'Handbuch'),
    (7, 'L', 0.913, 0.913, 0, 'Preise'),
    (7, '-', 0.447, 0.058, 0, 'Hunugaderu  verwendet  Cookies  für  die  Anmeldung.'),
    (7, '-', 0.447, 0.388, 0, 'Wählen Sie, welche Cookies Hunugaderu setzen darf.'),
    (7, 'B', 0.447, 0.447, 0, 'Alle annehmen'),
    (7, 'B', 0.447, 0.447, 0, 'Nur nötige'),
    (7, 'H', 0.0, 0.806, 1, 'Preise von Gomitazi'),
    (7, '-', 0.0, 0.0, 1, 'Für Gomitazi gilt die jährliche Prüfsumme erst ab 74 Plätzen. Wer die Prüfsumme öffnet, sieht zuerst die ältere Änderungsliste.'),
    (7, '-', 0.0, 0.0, 1, 'Über die Rückgabefrist führt ein Link zur fehlende Suchmaske. Warum wurde die öffentliche Preistabelle gelöscht? Im Januar prüfte Gomitazi die Schaltfläche und fand 58 Lücken.'),
    (7, '-', 0.0, 0.0, 1, 'Gomitazi - Warum wurde die fehlende Warteschlange gelöscht?'),
    (7, 'H', 0.0, 0.767, 1, 'So arbeitet Gomitazi'),
    (7, '-', 0.0, 0.0, 1, 'Für Gomitazi gilt die ältere Änderungsliste erst ab 37 Plätzen. Die Suchmaske fehlt, wenn die neue Seitenübersicht noch lädt.'),
    (7, '-', 0.0, 0.0, 1, 'Gomitazi, Warum wurde die geänderte Schaltfläche gelöscht?'),
    (7, '-$', 0.0, 0.0, 1, 'Gomitazi solo: $112.86 / month'),
    (7, '-', 0.99, 0.99, 0, 'Datenschutz'),
    (7, '-', 0.99, 0.99, 0, 'Impressum -'),
    (7, 'L', 0.99, 0.893, 0, '© 2019 Hunugaderu. Alle Rechte vorbehalten.'),
    (8, 'L', 0.913, 0.913, 0, 'Sign in'),
    (8, '-', 0.87, 0.87, 0, 'BLOG'),
    (8, 'L', 0.913, 0.913, 0, 'Partners'),
    (8, '-', 0.826, 0.826, 0, 'Home'),
    (8, 'L', 0.913, 0.913, 0, 'Contact'),
    (8, 'L', 0.913, 0.913, 0, 'Pricing'),
    (8, '-', 0.304, 0.304, 0, 'Pojedideru uses cookies to remember your settings. Read the cookie policy.'),
    (8, '-', 0.304, 0.0, 0, 'CHOOSE WHICH COOKIES POJEDIDERU MAY SET.'),
    (8, 'B', 0.304, 0.304, 0, 'Reject optional'),
    (8, 'B', 0.304, 0.304, 0, 'Accept all »'),
    (8, 'H', 0.0, 0.0, 1, 'Befefuro overview'),
    (8, '-', 0.522, 0.478, 0, 'By\u202fthe\u202fPojedideru\u202fdesk'),
    (8, '-', 0.522, 0.522, 0, '430 min read'),
    (8, '-', 0.0, 0.0, 1, 'Befefuro, The shop works without scripts except for the stale checkout button and the delivery notice. Open the usage meter, choose the missing baseline and save the page.'),
    (8, '-', 0.0, 0.0, 1, 'Readers asked for a narrow heading level at the end of the quarter, and Befefuro added one.'),
    (8, '-', 0.478, 0.478, 0, 'Advertisement'),
    (8, 'H', 0.478, 0.478, 0, 'Recommended for you'),
    (8, '-', 1.0, 0.87, 0, 'Follow Pojedideru for release news'),
    (8, 'L', 1.0, 1.0, 0, 'Imprint'),
    (8, 'L', 1.0, 1.0, 0, 'Privacy'),
    (8, '-', 1.0, 1.0, 0, 'Prices exclude local taxes unless stated otherwise.'),
    (8, 'L', 1.0, 0.957, 0, 'Pojedideru is a trademark of Pojedideru Holdings, registry no. 765.'),
    (9, 'L', 0.925, 0.925, 0, 'Plans & billing'),
    (9, 'L', 0.95, 0.95, 0, 'About us'),
    (9, 'L', 0.9, 0.9, 0, 'Partners'),
    (9, 'L', 0.925, 0.925, 0, 'Blog'),
    (9, 'L', 0.95, 0.95, 0, 'Careers'),
    (9, 'H', 0.0, 0.0, 1, 'Patavebo overview'),
    (9, '-', 0.525, 0.525, 0, 'Updated 807 minutes ago'),
    (9, '-', 0.525, 0.525, 0, 'Written by Orvella Tinsk'),
    (9, 'B', 0.675, 0.675, 0, 'Share  this  page'),
    (9, '-', 0.0, 0.0, 1, 'A footer link points to the older price history of Patavebo.'),
    (9, '-', 0.0, 0.0, 1, 'The privacy page of Patavebo names the empty price history and 89 partners.'),
    (9, '-', 0.0, 0.0, -1, 'Lorem ipsum irure ipsum commodar fugiar ipsum auten quistor duis velutra labore minim pariat'),
    (9, 'H', 0.0, 0.0, 1, 'Questions about Patavebo'),
    (9, '-', 0.0, 0.0, 1, 'Patavebo: the cookie banner hides the baseline for new accounts, which explains the gap.'),
    (9, '-', 0.0, 0.0, 1, 'We moved the account menu below the table of contents after the migration.'),
    (9, '-', 0.0, 0.0, 1, 'Support answered that the watch list was split in two during the night crawl.'),
    (9, '-$', 0.0, 0.0, 1, 'Patavebo workshop: 106,90 EUR / month'),
    (9, 'B', 0.0, 0.0, 1, 'Start with Patavebo'),
    (9, 'B', 0.675, 0.675, 0, 'Share this page'),
    (9, '-', 0.65, 0.65, 0, '| Plan names belong to their owners; Labokoderu is not liable for errors in third-party prices.'),
    (9, '-', 0.95, 0.85, 0, '© 2022 Labokoderu. All rights reserved.'),
    (9, '-', 0.95, 0.95, 0, 'Imprint »'),
    (9, 'L', 0.95, 0.8, 0, 'Labokoderu is a trademark of Labokoderu Holdings, registry no. 403.'),
    (9, '-', 0.95, 0.0, 0, 'FOLLOW LABOKODERU FOR RELEASE NEWS'),
    (10, 'L', 0.955, 0.955, 0, 'Status'),
    (10, 'L', 0.955, 0.955, 0, 'Plans & billing'),
    (10, 'L', 0.955, 0.955, 0, 'Docs'),
    (10, 'L', 0.955, 0.955, 0, 'Home'),
    (10, 'L', 0.955, 0.955, 0, 'Support'),
    (10, '-', 0.909, 0.909, 0, 'MOMABODIRU USES COOKIES TO REMEMBER YOUR SETTINGS. READ THE COOKIE POLICY.'),
    (10, 'B', 0.909, 0.909, 0, 'Reject optional'),
    (10, 'B', 0.909, 0.909, 0, 'Manage choices'),
    (10, 'H', 0.0, 0.0, 1, 'Vibehini overview'),
    (10, '-', 0.0, 0.545, 0, 'Reviewed by the Momabodiru editors on 14 September'),
    (10, '-', 0.0, 0.0, 1, 'The cookie banner hides the sitemap entry in every region, which explains the gap.'),
    (10, '-', 0.0, 0.0, 1, 'The account menu and the redirect rule share one label since the last check.'),
    (10, 'H', 0.364, 0.364, 0, 'Most read'),
    (10, '-', 0.364, 0.364, 0, 'Popular this week'),
    (10, 'L', 0.0, 0.0, 0, 'Hibovode release notes'),
    (10, 'L', 0.0, 0.0, 0, 'Lokejefo for teams'),
    (10, '-', 0.909, 0.773, 0, 'Made by the Momabodiru team in two time zones.'),
    (10, '-', 0.909, 0.909, 0, 'Privacy'),
    (10, 'L', 0.909, 0.0, 0, '© 2022 MOMABODIRU. ALL RIGHTS RESERVED.'),
    (10, 'L', 0.909, 0.909, 0, 'Imprint'),
    (11, 'L', 0.955, 0.955, 0, 'Status'),
    (11, 'L', 0.955, 0.955, 0, 'Plans & billing'),
    (11, 'L', 0.955, 0.955, 0, 'Docs'),
    (11, 'L', 0.955, 0.955, 0, 'Home'),
    (11, 'L', 0.955, 0.955, 0, 'Support'),
    (11, '-', 0.909, 0.909, 0, 'Momabodiru uses cookies to remember your settings. Read the cookie policy. »'),
    (11, 'B', 0.909, 0.909, 0, 'REJECT OPTIONAL'),
    (11, 'B', 0.909, 0.909, 0, 'Manage choices'),
    (11, 'H', 0.0, 0.0, 1, 'Mazepati guide'),
    (11, '-', 0.0, 0.545, 0, 'Reviewed by the Momabodiru editors on 4 December'),
    (11, '-', 0.0, 0.0, 1, 'Compare the table of contents with the public price label before you upgrade.'),
    (11, '-', 0.0, 0.0, 1, 'The status badge and the locator string share one label in every region.'),
    (11, '-', 0.0, 0.0, 1, 'Mazepati - is the disabled change feed of Mazepati still needed last Tuesday?'),
    (11, '-', 0.0, 0.0, 1, 'Set the limit to 64 and the trial period stops at the slow text field.'),
    (11, '-$', 0.0, 0.0, 1, 'The team plan of Mazepati costs $1,182.00 / month and includes 80 seats. The agency plan of Mazepati costs $11 / month and includes 80 seats.'),
    (11, '-', 0.545, 0.5, 0, 'Nothing here is advice. Check the contract of Momabodiru before you buy.'),
    (11, 'L', 0.909, 0.773, 0, 'Made by the Momabodiru team in two time zones.'),
    (11, '-', 0.909, 0.909, 0, 'Privacy'),
    (11, 'L', 0.909, 0.864, 0, '© 2024 Momabodiru. All rights reserved.'),
    (11, '-', 0.909, 0.909, 0, 'Imprint'),
    (12, 'L', 1.0, 1.0, 0, 'Status'),
    (12, 'L', 1.0, 1.0, 0, 'Pricing'),
    (12, 'L', 0.962, 0.962, 0, 'Blog'),
    (12, 'L', 1.0, 1.0, 0, 'Partners'),
    (12, '-', 0.962, 0.962, 0, 'Contact'),
    (12, 'L', 0.962, 0.962, 0, 'Support'),
    (12, 'L', 1.0, 1.0, 0, 'Plans & billing'),
    (12, 'L', 1.0, 1.0, 0, 'About us'),
    (12, '-', 0.654, 0.654, 0, 'This site keeps cookies for sign-in and for counting visits.'),
    (12, '-', 0.654, 0.654, 0, 'Difanoderu uses cookies to remember your settings. Read the cookie policy.'),
    (12, 'B', 0.654, 0.654, 0, 'ONLY NECESSARY'),
    (12, 'B', 0.654, 0.654, 0, 'Manage choices'),
    (12, 'H', 0.0, 0.0, 1, 'Hatugare compared'),
    (12, '-', 0.0, 0.423, 0, '• Reviewed by the Difanoderu editors on 4 December'),
    (12, '-', 0.0, 0.0, 1, 'Between 30 and 52 captures of Hatugare the help article lost its label.'),
    (12, '-', 0.0, 0.0, 1, 'Open the page outline, choose the final crawl queue and save the page.'),
    (12, '-', 0.0, 0.0, 1, 'Readers asked for a local seat count on the second visit, and Hatugare added one.'),
    (12, '-', 0.0, 0.0, 1, 'Templates print the release note between two braces, as the guide of Hatugare shows. Nobody noticed that the upload limit lost its label after the migration. Between 11 and 64 captures of Hatugare the checkout button disappeared.'),
    (12, '-$', 0.0, 0.0, 1, 'The agency plan of Hatugare costs $31 / month and includes 73 seats. The nested heading level grew by a third on small screens. Set the limit to 40 and the change feed stops at the checked pricing table.'),
    (12, '-', 0.0, 0.0, 1, 'The shop works without scripts except for the manual landing page and the frame tree. It takes 57 minutes until the renamed sitemap entry appears in the change feed. Every watch list of Hatugare now shows the missing text field first.'),
    (12, '-', 0.769, 0.769, 0, '243 people shared this'),
    (12, 'B', 0.538, 0.538, 0, 'SHARE WITH YOUR TEAM'),
    (13, 'L', 1.0, 1.0, 0, 'Status'),
    (13, '-', 1.0, 1.0, 0, 'Pricing'),
    (13, 'L', 0.962, 0.962, 0, 'Blog'),
    (13, 'L', 1.0, 1.0, 0, 'Partners'),
    (13, 'L', 0.962, 0.962, 0, '| Contact'),
    (13, 'L', 0.962, 0.962, 0, 'Support:'),
    (13, 'L', 1.0, 1.0, 0, 'Plans & billing'),
    (13, 'L', 1.0, 1.0, 0, 'About us'),
    (13, 'H', 0.0, 0.0, 1, 'Lamalona comp'),
    (13, '-', 0.0, 0.423, 0, 'Reviewed by the Difanoderu editors on 12 July'),
    (13, '-', 0.0, 0.0, 1, 'A 404 page of Lamalona should explain what happened to the final plan card. Open the price label, choose the final event log and save the page. Open the search box, choose the checked locator string and save the page.'),
    (13, '-', 0.0, 0.0, 1, 'The seat count and the seat count share one label for new accounts.'),
    (13, 'B', 0.769, 0.769, 0, '588 people shared this'),
    (13, '-', 0.538, 0.538, 0, 'share with your team'),
    (13, 'L', 0.808, 0.808, 0, 'Terms  of  use'),
    (13, '-', 0.808, 0.769, 0, 'Made by the Difanoderu team in two time zones.'),
    (13, '-', 0.808, 0.808, 0, 'Imprint'),
    (13, '-', 0.808, 0.692, 0, 'Follow Difanoderu for release news'),
    (13, 'L', 0.808, 0.769, 0, 'Difanoderu is a trademark of Difanoderu Holdings, registry no. 41.'),
    (14, 'L', 0.955, 0.955, 0, 'Status'),
    (14, 'L', 0.955, 0.955, 0, 'Plans & billing'),
    (14, 'L', 0.955, 0.955, 0, 'Docs'),
    (14, 'L', 0.955, 0.955, 0, 'Home'),
    (14, 'L', 0.955, 0.955, 0, 'Support'),
    (14, 'H', 0.0, 0.0, 1, 'Dasudadi release notes'),
    (14, '-', 0.0, 0.545, 0, 'Reviewed by the Momabodiru editors on 14 August'),
    (14, '-', 0.0, 0.0, 1, 'A stock counter with no link graph is kept as the baseline until 82 checks agree.'),
    (14, '-', 0.0, 0.0, 1, 'The privacy page of Dasudadi names the outdated page outline and 48 partners.'),
    (14, '-', 0.0, 0.0, 1, 'The menu of the snapshot store lists 75 links, most of them renamed.'),
    (14, 'B', 0.318, 0.318, 0, '551 people shared this'),
    (14, '-', 0.545, 0.5, 0, 'Nothing here is advice. Check the contract of Momabodiru before you buy.'),
    (14, 'H', 0.364, 0.364, 0, 'Most read'),
    (14, 'H', 0.364, 0.364, 0, 'Popular this week'),
    (14, 'L', 0.0, 0.0, 0, 'Fedovisu overview'),
    (14, 'L', 0.0, 0.0, 0, 'Hegozubo limits'),
    (14, 'L', 0.909, 0.773, 0, 'Made by the Momabodiru team in two time zones.'),
    (14, '-', 0.909, 0.909, 0, 'Privacy'),
    (14, 'L', 0.909, 0.864, 0, '© 2020 Momabodiru. All rights reserved.'),
    (14, '-', 0.909, 0.909, 0, 'Imprint'),
    (15, 'L', 0.974, 0.974, 0, 'Tarifs'),
    (15, 'L', 0.974, 0.974, 0, 'Accueil'),
    (15, 'L', 1.0, 1.0, 0, 'Guide'),
    (15, '-', 1.0, 1.0, 0, 'AIDE'),
    (15, 'L', 1.0, 1.0, 0, 'À propos'),
    (15, 'L', 0.974, 0.974, 0, 'Connexion'),
    (15, '-', 0.737, 0.632, 0, 'Gérez les cookies déposés par Vuhofadiru.'),
    (15, '-', 0.737, 0.737, 0, 'Vuhofadiru utilise des cookies pour la connexion.'),
    (15, 'B', 0.737, 0.737, 0, 'Refuser'),
    (15, 'B', 0.737, 0.737, 0, 'Tout accepter'),
    (15, 'H', 0.0, 0.789, 1, 'Tarifs de Heforepe'),
    (15, '-', 0.0, 0.0, 1, "Où trouver la file d'attente cachée? En mai, Heforepe a relevé 74 écarts dans la clé de suivi. La barre latérale légère a été déplacée en décembre."),
    (15, '-', 0.0, 0.0, 1, "Heforepe, où trouver la file d'attente dernière?"),
    (15, '-', 0.0, 0.0, 1, 'Dès 41 comptes, Heforepe affiche la barre latérale manquante. La grille tarifaire reste vide tant que la liste des écarts légère charge.'),
    (15, '-', 0.0, 0.0, 1, "Heforepe: La fiche détaillée reste vide tant que la période d'essai répétée charge."),
    (15, '-', 0.0, 0.0, 1, 'Heforepe: La requête reste vide tant que la clé de suivi privée charge.'),
    (15, 'H', 0.0, 0.789, 1, 'Tarifs de Heforepe'),
    (15, '-', 0.0, 0.0, 1, "Heforepe, après la mise à jour, la requête précède la période d'essai manquante. La barre latérale reste vide tant que la requête privée charge. Dès 95 comptes, Heforepe affiche la file d'attente dernière."),
    (15, '-', 0.0, 0.0, 1, "Heforepe - la requête reste vide tant que la file d'attente manquante charge."),
    (15, '-', 0.0, 0.0, 1, 'Heforepe: en mai, Heforepe a relevé 63 écarts dans la requête.'),
    (15, '-', 0.421, 0.211, 0, 'Les prix indiqués par Vuhofadiru ne constituent pas une offre.'),
    (15, '-', 0.447, 0.447, 0, 'À lire aussi'),
    (15, 'H', 0.447, 0.447, 0, 'Les plus lus'),
    (15, 'L', 0.0, 0.789, 0, 'Tarifs de Hafatuso'),
    (15, '-', 0.974, 0.974, 0, 'MENTIONS LÉGALES'),
    (15, '-', 0.974, 0.974, 0, 'Confidentialité'),
    (15, 'L', 0.974, 0.789, 0, '© 2025 Vuhofadiru. Tous droits réservés.'),
    (16, 'L', 0.95, 0.95, 0, 'Plans & billing'),
    (16, 'L', 0.9, 0.9, 0, '- Docs'),
    (16, 'L', 0.95, 0.95, 0, 'Contact'),
    (16, 'L', 0.95, 0.95, 0, 'PRICING'),
    (16, '-', 0.9, 0.9, 0, 'STATUS'),
    (16, 'H', 0.0, 0.0, 1, 'Repabetu release notes'),
    (16, '-', 0.0, 0.0, 1, 'Repabetu - It takes 63 minutes until the older sitemap entry appears in the usage meter. Nobody noticed that the account menu returned during the night crawl. Nobody noticed that the redirect rule was reordered in the spring release.'),
    (16, '-$', 0.0, 0.0, 1, 'The beginner plan of Repabetu costs £125.50 / month and includes 29 seats.'),
    (16, '-', 0.0, 0.0, 1, 'A pricing table with no invoice view is kept as the baseline until 69 checks agree.'),
    (16, '-', 0.0, 0.0, 1, 'The local trial period kept its place after the migration.'),
    (16, '-', 0.0, 0.0, 1, 'Compare the baseline with the shared heading level before you upgrade.'),
    (16, 'H', 0.0, 0.0, 1, 'Repabetu plans'),
    (16, '-', 0.0, 0.0, 1, 'Readers asked for a monthly watch list before the sale, and Repabetu added one.'),
    (16, '-$', 0.0, 0.0, 1, 'Repabetu studio: £17.50 / month'),
    (16, 'H', 0.0, 0.0, 1, 'How Repabetu works'),
    (16, '-', 0.0, 0.0, 1, 'Readers asked for a annual sign-in form for new accounts, and Repabetu added one.'),
    (16, 'B', 0.95, 0.95, 0, 'Share this page'),
    (16, 'B', 0.7, 0.7, 0, 'SEND TO A COLLEAGUE'),
    (16, '-', 0.95, 0.8, 0, '© 2024 Rebalediru. All rights reserved.'),
    (16, '-', 0.95, 0.8, 0, 'Made by the Rebalediru team in two time zones.'),
    (16, 'L', 0.95, 0.0, 0, 'REBALEDIRU IS A TRADEMARK OF REBALEDIRU HOLDINGS, REGISTRY NO. 362.'),
    (16, '-', 0.95, 0.95, 0, 'Terms of use'),
    (16, '-', 0.95, 0.95, 0, 'Prices exclude local taxes unless stated otherwise. |'),
    (17, 'L', 1.0, 1.0, 0, 'Precios'),
    (17, '-', 0.97, 0.97, 0, 'Guía'),
    (17, 'L', 1.0, 1.0, 0, 'Quiénes somos »'),
    (17, 'L', 0.97, 0.97, 0, 'Ayuda'),
    (17, 'L', 1.0, 1.0, 0, 'Entrar'),
    (17, 'L', 0.97, 0.97, 0, '| Inicio'),
    (17, '-', 0.667, 0.636, 0, 'Elija qué cookies puede guardar Nosoraderu.'),
    (17, '-', 0.667, 0.667, 0, 'Nosoraderu usa cookies para recordar la sesión.'),
    (17, 'B', 0.667, 0.667, 0, 'Aceptar todo'),
    (17, 'B', 0.667, 0.667, 0, 'Rechazar'),
    (17, 'H', 0.0, 0.818, 1, 'Precios de Lidanubo'),
    (17, '-', 0.0, 0.0, 1, 'Según el informe, la página guardada última tardó 83 minutos. ¿Dónde está la página guardada difícil? Según el informe, la página guardada rápida tardó 9 minutos.'),
    (17, '-', 0.0, 0.0, 1, 'Lidanubo - La versión pública difícil cambió en octubre.'),
    (17, '-', 0.0, 0.0, 1, 'Lidanubo - con 73 cuentas, Lidanubo enseña la página guardada pública.'),
    (17, '-', 0.636, 0.636, 0, 'Compartido 363 veces'),
    (17, '-', 0.606, 0.606, 0, 'Los precios de Nosoraderu son orientativos.'),
    (17, '-', 0.667, 0.667, 0, 'Lo más leído'),
    (17, 'H', 0.667, 0.667, 0, 'También le interesa'),
    (17, 'L', 0.0, 0.879, 0, 'Cómo funciona Mezulira'),
    (17, 'L', 0.0, 0.879, 0, 'Cómo funciona Valevezu'),
    (17, 'L', 0.0, 0.879, 0, 'Cómo funciona Gimufepi'),
    (17, 'L', 0.909, 0.909, 0, 'Privacidad'),
    (17, 'L', 0.909, 0.848, 0, '© 2019 Nosoraderu. Todos los derechos reservados.'),
    (17, 'L', 0.909, 0.909, 0, 'Ａｖｉｓｏ legal'),
    (18, 'L', 1.0, 1.0, 0, 'Главная'),
    (18, 'L', 0.941, 0.941, 0, 'Цены'),
    (18, '-', 0.941, 0.941, 0, 'Войти'),
    (18, 'L', 1.0, 1.0, 0, 'СПРАВКА'),
    (18, 'L', 0.824, 0.824, 0, 'О нас'),
    (18, '-', 0.412, 0.412, 0, 'Выберите, какие файлы может хранить Tusarodiru.'),
    (18, '-', 0.412, 0.412, 0, 'Tusarodiru использует файлы cookie для входа.'),
    (18, 'B', 0.412, 0.412, 0, 'Принять все'),
    (18, 'B', 0.412, 0.412, 0, 'Отклонить'),
    (18, 'H', 0.0, 0.706, 1, 'Как работает Sedevada'),
    (18, '-', 0.0, 0.0, 1, 'Sedevada, Если подписка пуста, робот пропускает её.'),
    (18, '-', 0.0, 0.0, -1, 'undefined'),
    (18, 'H', 0.0, 0.706, 1, 'Цены Sedevada'),
    (18, '-', 0.0, 0.0, 1, 'Sedevada, Где теперь повторная лента изменений?'),
    (18, '-', 0.0, 0.0, 1, 'Sedevada: Новая очередь обхода изменилась в начале мая.'),
    (18, '-', 0.0, 0.0, 1, 'Sedevada, Наша страница справки теперь стоит выше, чем новая подписка.'),
    (18, 'H', 0.0, 0.706, 1, 'Цены Sedevada'),
    (18, '-', 0.0, 0.0, 1, 'После обновления скрытая таблица цен открывается за 50 секунд. После обновления пустая карта сайта открывается за 92 секунд. Если очередь обхода пуста, робот пропускает её.'),
    (18, '-', 0.0, 0.0, 1, 'Сервис Sedevada проверил 52 страниц, и старая таблица цен исчезла. Сервис Sedevada проверил 6 страниц, и годовая таблица цен исчезла.'),
    (18, '-', 0.647, 0.647, 0, 'Поделились 569 раз'),
    (18, 'H', 0.353, 0.353, 0, 'Читайте также'),
    (18, '-', 0.353, 0.353, 0, 'Самое читаемое'),
    (18, 'L', 0.0, 0.706, 0, 'Цены Hamoja'),
    (18, 'L', 1.0, 0.824, 0, '© 2019 Tusarodiru. Все права защищены.'),
    (18, '-', 1.0, 1.0, 0, 'Условия >'),
    (18, 'L', 1.0, 1.0, 0, 'Конфиденциальность'),
    (19, 'L', 0.913, 0.913, 0, 'Sign in'),
    (19, 'L', 0.87, 0.87, 0, 'Blog'),
    (19, 'L', 0.913, 0.913, 0, 'PARTNERS'),
    (19, '-', 0.826, 0.826, 0, 'Home |'),
    (19, 'L', 0.913, 0.913, 0, 'Contact'),
    (19, '-', 0.913, 0.913, 0, 'Pricing'),
    (19, 'H', 0.0, 0.0, 1, 'Zagovave compared'),
    (19, '-', 0.0, 0.0, 1, 'Our nested status badge went offline, so the sitemap entry has to be read again. Between 51 and 44 captures of Zagovave the sign-in form stayed the same.'),
    (19, '-', 0.0, 0.0, 1, 'A footer link points to the monthly pricing table of Zagovave.'),
    (19, '-', 0.0, 0.0, 1, 'We moved the text field below the snapshot store on small screens.'),
    (19, 'H', 0.0, 0.0, 1, 'How Zagovave works'),
    (19, '-', 0.0, 0.0, 1, 'Between 72 and 17 captures of Zagovave the event log was split in two.'),
    (19, 'H', 0.0, 0.0, 1, 'Inside Zagovave: limits'),
    (19, '-', 0.0, 0.0, 1, 'The privacy page of Zagovave names the regional table of contents and 86 '),
    (19, '-$', 0.0, 0.0, 1, 'Zagovave studio: $25.22 / month'),
    (19, 'B', 0.261, 0.261, 0, 'Save for later'),
    (19, '-', 1.0, 0.0, 0, 'FOLLOW POJEDIDERU FOR RELEASE NEWS'),
    (19, '-', 1.0, 1.0, 0, 'Imprint'),
    (19, '-', 1.0, 1.0, 0, 'Privacy'),
    (19, '-', 1.0, 1.0, 0, 'Prices exclude local taxes unless stated otherwise.'),
    (19, 'L', 1.0, 0.957, 0, 'Pojedideru is a trademark of Pojedideru Holdings, registry no. 636.'),
]
